"""Trees of any depth against a recursion."""

import hashlib
import json
import random

from tessera.operators import trees


def _grown(rng, depth):
    roll = rng.random()
    if depth == 0 or roll < 0.3:
        return {"t": "Str", "c": rng.choice(["a", "Ж", "", "x\ny", "12"])}
    if roll < 0.4:
        return {"t": "Space"}
    if roll < 0.5:
        return {"t": "Link", "url": f"http://x/{rng.randint(0, 9)}", "c": [[_grown(rng, depth - 1)], [], 7, None]}
    return {"t": rng.choice(["Para", "Div"]), "c": [_grown(rng, depth - 1) for _ in range(rng.randint(0, 4))]}


def _brute(v, path=(), depth=0):
    if isinstance(v, list):
        for i, x in enumerate(v):
            yield from _brute(x, (*path, i), depth)
    elif isinstance(v, dict) and "t" in v:
        yield path, depth, v["t"], v["c"] if isinstance(v.get("c"), str) else None, v.get("url")
        if isinstance(v.get("c"), list):
            yield from _brute(v["c"], path, depth + 1)


def test_walk_equals_a_recursion(spark):
    rng = random.Random(2)
    given = {i: _grown(rng, i % 7) for i in range(60)} | {100: [_grown(rng, 3), [_grown(rng, 2)]]}
    rows = [(i, json.dumps(v)) for i, v in given.items()] + [(200, None), (201, "{broken"), (202, "3")]
    nodes = trees.walk(spark.createDataFrame(rows, "doc long, ast string"), "doc", "ast")
    want = sorted((i, *n) for i, v in given.items() for n in _brute(v))
    got = sorted((r.doc, tuple(r.path), r.depth, r.kind, r.text, r.url) for r in nodes.collect())
    assert list(map(repr, got)) == list(map(repr, want)) and max(w[2] for w in want) > 4
    for r in trees.outline(nodes, "doc").collect():
        own = sorted((n for n in _brute(given[r.doc])), key=lambda n: n[0])
        text = " ".join(n[3] for n in own if n[3] is not None)
        assert (r.nodes, r.depth, r.links, r.digest) == (len(own), max(n[1] for n in own), sum(n[4] is not None for n in own), hashlib.md5(text.encode()).hexdigest())
