"""Merges against plain Python; versions of the register."""

import random

from tessera.operators import merges as M
from tessera.operators.planning import canonical

ENTITIES = "id long, name string, aliases array<string>, active boolean, merged_into long, last_used long"
REFERENCES = "ref long, entity long, kind string, version long"
PAIRS = "source long, target long"


def _entities(spark, rows):
    return spark.createDataFrame(rows, ENTITIES)


def _state(tables):
    e, r = tables
    return sorted((x.id, x.name, tuple(x.aliases or []), x.active, x.merged_into, x.last_used) for x in e.collect()), sorted(map(repr, r.select("ref", "entity", "kind", "version").collect()))


def test_roots_are_the_connected_entities(spark):
    rng = random.Random(1)
    own = [(i, f"n{i}", [], True, rng.choice([None, None, None, rng.randint(1, 60)]), i) for i in range(1, 61)]
    own = [(i, n, a, b, None if m == i else m, u) for i, n, a, b, m, u in own]
    pairs = [(rng.randint(1, 60), rng.randint(1, 62)) for _ in range(25)] + [(None, 1), (1, None), (5, 5)]
    got = {r.id: r.root for r in M.united(_entities(spark, own), spark.createDataFrame(pairs, PAIRS)).collect()}
    group = {i: i for i in range(1, 61)}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in [(i, m) for i, _, _, _, m, _ in own if m] + pairs:
        if a in group and b in group:
            group[top(a)] = top(b)
    assert {(a, b) for a in group for b in group if got[a] == got[b]} == {(a, b) for a in group for b in group if top(a) == top(b)}
    assert all(got[r] == r for r in got.values()) and len(set(got.values())) > 5


def test_circles_of_any_length(spark):
    own = {1: 2, 2: 1, 3: 4, 4: 5, 5: 6, 6: 3, 7: 8, 8: 9, 9: 7, 10: 6, 11: 11, 12: 11, 13: None, 14: 99, 15: 14}
    rows = spark.createDataFrame(list(own.items()), "id long, merged_into long")
    got = {r.id: r.target for r in canonical(rows).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 7: 7, 8: 7, 9: 7, 10: 3, 11: 11, 12: 11, 13: 13, 14: 14, 15: 14}


def test_chain_circle_and_versions(spark):
    rows = [(1, "A", ["x"], True, None, 10), (2, "B", ["y", "A", ""], True, None, 30), (3, "C", None, True, None, None), (4, "D", [], True, None, 5), (5, "E", [], True, None, 5), (6, "F", [], False, None, 1)]
    refs = [(100, 1, "k", 1), (101, 1, "k", 4), (102, 2, "k", 2), (103, 2, "k", 1), (104, 3, "k", 1), (105, 3, None, 7), (106, 1, None, 2), (107, 99, "k", 1), (108, None, "k", 1), (109, 2, "j", 3)]
    pairs = [(3, 2), (2, 1), (4, 5), (5, 4), (6, 77)]
    given = _entities(spark, rows), spark.createDataFrame(refs, REFERENCES), spark.createDataFrame(pairs, PAIRS)
    e, r = M.merged(*given)
    assert _state((e, r))[0] == [(1, "A", ("x", "B", "y", "C"), True, None, 30), (2, "B", ("y", "A", ""), False, 1, 30), (3, "C", (), False, 1, None), (4, "D", ("E",), True, None, 5), (5, "E", (), False, 4, 5), (6, "F", (), False, None, 1)]
    assert {x.ref: (x.entity, x.version) for x in r.collect()} == {100: (1, 1), 101: (1, 4), 103: (1, 5), 102: (1, 6), 104: (1, 7), 106: (1, 2), 105: (1, 3), 107: (99, 1), 108: (None, 1), 109: (1, 1)}


def test_versions_of_the_register(spark, tmp_path):
    e = _entities(spark, [(i, f"n{i}", [], True, None, i) for i in range(1, 7)])
    r = spark.createDataFrame([(i, 1 + i % 6, "k", 1) for i in range(12)], REFERENCES)
    store = M.Register(spark, str(tmp_path / "register"))
    assert store.change(lambda *_: (e, r)) == 1
    first = _state(store.tables())
    pairs = spark.createDataFrame([(2, 1), (3, 2)], PAIRS)
    assert store.merge(pairs) == 2
    second = _state(store.tables())
    assert second != first
    assert store.merge(pairs) == 3 and _state(store.tables()) == second
    late = M.Register(spark, store.path)
    store.merge(spark.createDataFrame([(4, 1)], PAIRS))
    assert late.merge(spark.createDataFrame([(5, 6), (1, 5)], PAIRS)) == 5
    assert {x.id for x in late.tables()[0].where("merged_into = 6").collect()} == {1, 2, 3, 4, 5}
    assert late.undo(1) == 6 and _state(M.Register(spark, store.path).tables()) == first


def test_names_are_found_or_created(spark):
    e = _entities(spark, [(1, "Жёлтый", [], True, 2, 1), (2, "Red", [], False, None, 1), (3, "Blue", [], False, None, 9)])
    names = [("желтый ", 5), ("BLUE", 4), ("new  one", 3), ("New one", 7), ("alpha", 1), ("", 1), (None, 2)]
    found, after = M.resolved(e, spark.createDataFrame(names, "name string, at long"))
    assert {x.name: (x.id, x.created) for x in found.collect()} == {"желтый ": (2, False), "BLUE": (3, False), "new  one": (5, True), "New one": (5, True), "alpha": (4, True), "": (None, False), None: (None, False)}
    assert sorted((x.id, x.name, x.active, x.last_used) for x in after.collect()) == [(1, "Жёлтый", True, 1), (2, "Red", True, 5), (3, "Blue", True, 9), (4, "alpha", True, 1), (5, "New one", True, 7)]
    again, same = M.resolved(after, spark.createDataFrame(names, "name string, at long"))
    assert not again.where("created").count() and _state((same, spark.createDataFrame([], REFERENCES))) == _state((after, spark.createDataFrame([], REFERENCES)))
