"""Automata as scans against a fold."""

import random

import pytest

from tessera.operators import automata


@pytest.mark.parametrize("chunk", [2, 3, 256])
def test_scan_equals_a_fold(spark, monkeypatch, chunk):
    monkeypatch.setattr(automata, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows, want = [], {}
    for doc in range(12):
        state, at = 2, 0
        for _ in range(rng.choice([0, 1, 2, 5, 40])):
            at += rng.choice([0, 0, 3])  # gaps
            move = [rng.randrange(5) for _ in range(5)]
            rows.append((doc, at, move, "x"))
            want[doc, at] = (state, move[state])
            state, at = move[state], at + 1
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 0, [0] * 5, "x"), (99, None, [0] * 5, "x")], "doc long, n int, move array<int>, before string")
    got = automata.scan(df, "doc", "n", "move", 5, start=2)
    assert {(r.doc, r.n): (r.before, r.after) for r in got.collect()} == want
    assert automata.scan(df.limit(0), "doc", "n", "move", 5).count() == 0


def test_open_parts_follow_the_headings(spark, monkeypatch):
    monkeypatch.setattr(automata, "CHUNK", 4)
    rng = random.Random(5)
    rows, want = [], {}
    for doc in range(20):
        abstract = references = False
        for place in range(rng.randint(1, 60)):
            role = rng.choice(["abstract_heading", "keywords", "section", "references_heading", *["paragraph"] * 6])
            part = "reference" if references and role == "paragraph" else "abstract" if abstract and role == "paragraph" else role
            want[doc, place] = (abstract, references, part)
            rows.append((doc, place, role))
            if role == "abstract_heading":
                abstract = True
            elif role in ("keywords", "section", "references_heading"):
                abstract = False
            references = role == "references_heading" or references and role != "section"
    got = automata.open_parts(spark.createDataFrame(rows, "doc_id long, place int, role string"))
    assert {(r.doc_id, r.place): (r.abstract_open, r.references_open, r.part) for r in got.collect()} == want


def test_moves_name_every_state(spark):
    with pytest.raises(ValueError, match="each state"):
        automata.transitions(3, {"a": [0, 1]}, None)
