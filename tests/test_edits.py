"""Edits of texts against plain Python."""

import random

from tessera.operators import edits as E

SCHEMA = "doc_id long, id long, start long, end long, new string"
ALPHABET = "aж😀\n é[1]x"


def _brute(text, rows):
    last, out, at = 0, [], 0
    for _, start, end, new in sorted(rows, key=lambda r: (r[1], r[2] > r[1], -r[2], r[0])):
        if start >= last:
            out += [text[at:start], new or ""]
            last = at = end
    return "".join([*out, text[at:]])


def test_edits_and_their_inverse(spark):
    rng = random.Random(3)
    texts = {i: "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 40]))) for i in range(80)}
    rows = []
    for d, t in texts.items():
        for i in range(rng.randint(0, 8)):
            a, b = sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))
            rows.append((d, i, a, b if rng.random() < 0.7 else a, rng.choice(["", "N", "😀ж", "long one", None])))
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bad = [(1, 90, 3, 2, "x"), (1, 91, -1, 0, "x"), (None, 92, 0, 0, "x"), (1, 93, None, 1, "x"), (999, 94, 0, 0, "x")]
    stand = E.settled(spark.createDataFrame(rows + bad, SCHEMA))
    new = E.applied(table, stand)
    got = {r.doc_id: r.text for r in new.collect()}
    assert got == {d: _brute(t, [r[1:] for r in rows if r[0] == d]) for d, t in texts.items()} and got != texts
    back = E.applied(new, E.settled(E.inverse(table, stand)))
    assert {r.doc_id: r.text for r in back.collect()} == texts
    for r in E.placed(stand).where("doc_id < 900").collect():
        assert got[r.doc_id][r.at :].startswith(r.new)


def test_null_text_and_places_beyond_the_end(spark):
    table = spark.createDataFrame([(1, None, "k"), (2, None, "k"), (3, "ab", "k"), (None, "x", "k")], "doc_id long, text string, _c2 string")
    got = {(r.doc_id, r.text) for r in E.applied(table, E.settled(spark.createDataFrame([(1, 0, 0, 0, "n"), (3, 1, 1, 9, "!"), (3, 2, 50, 60, "?")], SCHEMA))).collect()}
    assert got == {(1, "n"), (2, None), (3, "a!?"), (None, "x")}
    empty = spark.createDataFrame([], SCHEMA)
    assert E.applied(table, E.settled(empty)).count() == 4


def test_markers_join_and_number_on(spark):
    table = spark.createDataFrame([(1, "One claim. Another [2, 1]. Last"), (2, "Plain"), (3, None)], "doc_id long, text string")
    chosen = [(1, 18, 70, "B"), (1, 9, 71, "A"), (1, 9, 70, "B2"), (1, 31, 71, "A"), (1, 99, 72, "out"), (1, None, 73, "no"), (2, 5, 70, None), (2, 5, 70, None), (2, 5, None, "no"), (3, 0, 9, "Z")]
    found = E.citations(table, spark.createDataFrame(chosen, "doc_id long, place long, source long, title string"), "References")
    got = {r.doc_id: r.text for r in E.applied(table, E.settled(found)).collect()}
    assert got == {1: "One claim [3, 4]. Another [1, 2, 3]. Last [4]\nReferences\n[3] B\n[4] A", 2: "Plain [1]\nReferences\n[1] ", 3: " [1]\nReferences\n[1] Z"}
