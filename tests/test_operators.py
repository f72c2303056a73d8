"""Operators on rows that the tables don't hold: other scripts, citations, nulls, ties, boundaries."""

import hashlib
import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrow as A
from tessera.functions import text as X
from tessera.operators import documents as D
from tessera.operators import registry as R
from tessera.operators import resolution as Z
from tessera.operators import workflow as W


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def test_normalising(spark):
    assert one(spark, "  Ёлка\x00 и  Straße!  ", X.normalise) == "елка и strasse!"
    assert one(spark, "Ёлка, и «ель»", lambda c: X.normalise(c, keep_punctuation=False)) == "елка и ель"
    assert one(spark, "Привет a bc Мир123", X.tokens) == ["привет", "мир123"]
    assert one(spark, None, X.tokens) == []
    assert one(spark, "щука Юля", X.transliterate) == "shchuka yulya"


def test_stemming_takes_the_first_suffix(spark):
    assert one(spark, "моделями", lambda c: X.stem(c, ("ями", "ами", "и"))) == "модел"
    assert one(spark, "дами", lambda c: X.stem(c, ("ами", "и"))) == "дами"


def _embedding(words):
    """The definition, feature by feature."""
    out = [0.0] * 384
    named = [("w:" + w, 1.0) for w in words] + [("g:" + w[i : i + 3], 0.18) for w in words if len(w) >= 6 for i in range(len(w) - 2)]
    for name, weight in named + [(f"b:{a}:{b}", 0.45) for a, b in zip(words, words[1:], strict=False)]:
        n = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        out[n % 384] += weight if n & 1 else -weight
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def test_hashed_embedding_equals_its_definition(spark):
    rows = [["models", "rivers", "rivers", "abc"], [], None, ["x"], ["модел", "потоков", "река"], ["abcdef"] * 5]
    got = [r.e for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<string>").coalesce(1).select("i", A.hash_embedding("w").alias("e")).orderBy("i").collect()]
    for r, e in zip(rows, got, strict=True):
        assert (e is None) == (r is None) and (r is None or e == pytest.approx(_embedding(r), abs=1e-12))


def test_content_tokens_keep_repeats(spark):
    assert one(spark, "The river and the river, delta", X.content_tokens) == ["river", "river", "delta"]
    assert one(spark, "Реками и моделями, дом-2 abc", X.embedded_tokens) == ["рекам", "и", "модел", "дом-2", "abc"]


def test_field_weights_count_repeats(spark):
    from tessera.operators import retrieval as T

    rows = spark.createDataFrame([(1, "river river", "delta"), (2, "delta", "stone")], "id long, title string, abstract string")
    got = {(r.id, r.term): r.tf for r in T.weighted_counts(rows, {"title": 3.0, "abstract": 2.0}, "id").collect()}
    assert got == {(1, "river"): 6.0, (1, "delta"): 2.0, (2, "delta"): 3.0, (2, "stone"): 2.0}
    total = spark.createDataFrame([(2,)], "total long")
    counts = T.weighted_counts(rows, {"title": 3.0, "abstract": 2.0}, "id")
    idf = {"river": math.log(3 / 2) + 1, "delta": 1.0, "stone": math.log(3 / 2) + 1}
    one_, two = {"river": 6 * idf["river"], "delta": 2.0}, {"delta": 3.0, "stone": 2 * idf["stone"]}
    cosine = 2 * 3 / math.sqrt(sum(x * x for x in one_.values()) * sum(x * x for x in two.values()))
    sims = {(r.q, r.id): (r.shared, r.cosine) for r in T.tfidf_similarity(counts.withColumnRenamed("id", "q"), counts, total, "id", "q").collect()}
    assert sims[(1, 2)] == (1, pytest.approx(cosine, abs=1e-5)) and sims[(1, 1)] == (2, pytest.approx(1.0))


def test_scripts(spark):
    assert one(spark, "Это русский текст достаточной длины", X.script_language) == "ru"
    assert one(spark, "A text long enough in English", X.script_language) == "en"
    assert one(spark, "12 34", X.script_language) == "unknown"
    assert one(spark, "cистема и система, Hello", X.mixed_script_tokens) == ["cистема"]


def test_identifiers(spark):
    assert one(spark, "ISSN 1234-567x, 12345678 and 123456789", X.issn) == ["1234-567X", "1234-5678"]
    for value, fine in (("0000-0002-1825-0097", True), ("0000-0002-1694-233X", True), ("0000-0002-1825-0098", False), ("x", False)):
        assert one(spark, value, X.orcid_valid) is fine


def test_citations(spark):
    rows = [("a [1] b [3-5; 2]", 5), ("[1-99]", 5), ("[2, 9]", 5), ("[3–4]", 5), ("none", 5), ("[0]", 5), ("[5-3]", 5)]
    got = D.citations(spark.createDataFrame(rows, "text string, n int"), F.col("n")).collect()
    assert [r.cited for r in got] == [[1, 3, 4, 5, 2], [], [], [3, 4], [], [], []]
    gaps = spark.createDataFrame([([1, 7], [1, 2])], "c array<int>, a array<int>").select(D.reference_gaps(F.col("c"), F.col("a")).alias("g")).first().g
    assert (gaps.unknown, gaps.uncited) == ([7], [2])


def test_references_are_cut_past_a_third(spark):
    text = "References early. " + "word " * 60 + "References\n1. A"
    assert one(spark, text, D.without_references) == text[: text.rindex("References")].rstrip()
    assert one(spark, "References only at the start " + "x " * 50, D.without_references).startswith("References")


def test_chunks_overlap(spark):
    sents = [f"Sentence {i} has some words in it and goes on for a while." for i in range(8)]
    got = spark.createDataFrame([(sents,)], "s array<string>").select(D.packed(F.col("s"), most=150).alias("c")).first().c
    assert all(len(c) <= 150 for c in got) and got[0].endswith(sents[1]) and got[1].startswith(sents[1])
    assert got[-1].endswith(sents[-1])


def test_captions(spark):
    rows = [(1, "Figure 1. A"), (1, "Fig. 3"), (1, "Рисунок 2 — б"), (2, "Table 1"), (2, "table 2")]
    got = D.caption_issues(spark.createDataFrame(rows, "doc long, text string"), "doc").collect()
    assert sorted((r.doc, r.kind, r.missing) for r in got) == [(1, "fig", [1, 2]), (1, "рисунок", [1])]


def test_claim_type_ties_go_to_the_first(spark):
    assert one(spark, "the data of this method", D.claim_type) == "method"
    assert one(spark, "nothing here", D.claim_type) == "topic"


def test_half_even_percent(spark):
    rows = [(1, 40), (3, 40), (5, 200), (7, 200), (5, 0), (9, 3)]
    got = spark.createDataFrame(rows, "a int, b int").select(R.percent(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in got] == [2, 8, 2, 4, 0, 100]


def test_academic_year(spark):
    df = spark.sql("SELECT explode(array(date'2024-08-31', date'2024-09-01')) AS d").select(R.academic_year(F.col("d")).alias("y"))
    assert [r.y for r in df.collect()] == ["2023/2024", "2024/2025"]


def test_visibility_of_null_combinations(spark):
    tasks = spark.createDataFrame([(1, 7, None, None), (2, None, "g", None), (3, None, "g", 5), (4, None, "g", 6), (5, None, None, 5), (6, 8, "g", None)], "task_id int, task_user int, task_group string, task_unit int")
    users = spark.createDataFrame([(7, "g", 5), (9, "g", None), (8, "h", 6)], "user_id int, user_group string, user_unit int")
    got = tasks.join(users, W.visible(tasks, users)).select("user_id", "task_id").collect()
    assert sorted(map(tuple, got)) == [(7, 1), (7, 2), (7, 3), (8, 6), (9, 2)]


def test_upsert_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a", False), (2, "b", True), (3, "c", False)], "k int, v string, held boolean")
    incoming = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "k int, v string")
    first = W.upsert(stored, incoming, "k", ["v"], "held", [])
    assert {r.k: (r.v, r.action) for r in first.collect()} == {1: ("x", "update"), 2: ("b", "keep"), 3: ("c", "stale"), 4: ("z", "create")}
    again = W.upsert(first.drop("action"), incoming, "k", ["v"], "held", [])
    assert {r.action for r in again.collect()} == {"keep", "stale"}


def test_allocation_keeps_capacities(spark):
    rows = [(1, 10, f, 2, s) for f, s in ((100, 0.9), (101, 0.8), (102, 0.7))] + [(1, 11, 100, 1, 0.95), (1, 11, 102, 1, 0.6), (2, 12, 103, 0, 1.0)]
    got = Z.allocate(spark.createDataFrame(rows, "owner long, plan long, fact long, capacity int, score double"))
    assert sorted((r.plan, r.fact) for r in got.collect()) == [(10, 101), (10, 102), (11, 100)]


def test_titles_meet_without_a_word_and_without_copies(spark):
    plans = spark.createDataFrame([(1, 10, "ab cd ef gh ij kl"), (1, 11, "blue large bolt"), (None, 12, "blue large bolt")], "owner long, plan long, plan_title string")
    facts = spark.createDataFrame([(1, 20, "AB-CD EF GH IJ KL mn"), (1, 21, "large blue ring"), (1, 22, None), (2, 23, "blue large bolt")], "owner long, fact long, fact_title string")
    got = Z.title_candidates(plans, facts, ["owner"])
    assert sorted((r.owner, r.plan, r.fact, round(r.score, 6)) for r in got.collect()) == [(1, 10, 20, 1.0), (1, 11, 21, round(0.72 * 2 / 3 + 0.28 * 2 / 3, 6))]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join") == 1  # no row a word, and no way back from titles to rows


def test_title_scores(spark):
    df = spark.createDataFrame([("A study of river deltas", "A study of river deltas in winter"), ("river deltas study", "winter river ecology deltas"), ("one thing", "another")], "p string, f string")
    got = [r.s for r in df.select(Z.title_score(F.col("p"), F.col("f")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0.72 * 2 / 4 + 0.28 * 2 / 3) and got[2] == 0.0


def test_merging_entities(spark):
    rows = spark.createDataFrame([(1, "Main", ["m"]), (2, "Other", ["o"]), (3, "Lone", [])], "id int, name string, aliases array<string>")
    got = Z.merge_entities(rows, spark.createDataFrame([(2, 1)], "id int, merged_into int")).collect()
    assert {r.id: r.aliases for r in got} == {1: ["Other", "m", "o"], 3: []}


def test_deep_merge():
    base = {"a": {"x": 1, "y": 2}, "blocks": [{"role": "title", "size": 12}, {"role": "body", "size": 10}], "keep": "v"}
    over = {"a": {"x": 5}, "blocks": [{"role": "body", "size": 11}, {"role": "note", "size": 8}], "keep": "", "new": 1}
    assert A.merged(base, over) == {"a": {"x": 5, "y": 2}, "blocks": [{"role": "title", "size": 12}, {"role": "body", "size": 11}, {"role": "note", "size": 8}], "keep": "v", "new": 1}
    blocks = {"blocks": [{"role": "Title", "a": 1}, {"x": 1}]}
    assert A.merged(blocks, {"blocks": [{"role": "title", "b": 2}, {"y": 2}]}) == {"blocks": [{"role": "title", "a": 1, "b": 2}, {"x": 1}, {"y": 2}]}
    assert A.merged({"a": [1]}, {"a": [{"role": "q"}]}) == {"a": [{"role": "q"}]}  # only under their key are blocks merged by role


def test_merged_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": 2}}', '{"b": {"d": 3}, "a": null}'), (None, "{broken"), ('{"z": 1}', None)], "b string, o string")
    assert [r.m for r in df.select(A.merged_json("b", "o").alias("m")).collect()] == ['{"a": 1, "b": {"c": 2, "d": 3}}', "{}", '{"z": 1}']


def _in_order(edges, room):
    """The order taken one by one."""
    left, taken, out = dict(room), set(), set()
    for owner, plan, fact, score in sorted(edges, key=lambda e: (-e[3], e[2], e[1])):
        if fact not in taken and left[plan] > 0:
            left[plan] -= 1
            taken.add(fact)
            out.add((owner, plan, fact, score))
    return out, left, taken


def test_allocation_in_rounds_equals_the_order(spark):
    rng = random.Random(31)
    room = {p: rng.randint(0, 4) for p in range(40)}
    edges = list({(p % 3, p, f): (p % 3, p, f, rng.choice([0.5, 0.6, 0.7, 0.8])) for p in range(40) for f in range(p % 3, 90, 3) if rng.random() < 0.4}.values())
    # a chain in which every choice hangs on the one before it
    edges += [(7, 100 + i, 1000 + i + d, 0.99 - 0.01 * (2 * i + d)) for i in range(12) for d in (0, 1)]
    room |= {100 + i: 1 for i in range(12)}
    df = spark.createDataFrame([(*e, room[e[1]]) for e in edges], "owner long, plan long, fact long, score double, capacity int")
    got = Z.allocate(df)
    want, left, taken = _in_order(edges, room)
    assert {tuple(r) for r in got.collect()} == want
    # what is left goes to generic plans first, then by id
    plans = [(p % 3, p, room[p], p % 5 == 0) for p in range(40)]
    facts = [(f % 3, f) for f in range(90)] + [(2, 500 + i) for i in range(60)]
    more = set()
    for owner, plan, _, _ in sorted(plans, key=lambda x: (not x[3], x[1])):
        for own, fact in sorted(facts, key=lambda x: x[1]):
            if left[plan] > 0 and own == owner and fact not in taken:
                left[plan] -= 1
                taken.add(fact)
                more.add((owner, plan, fact))
    filled = Z.fill_capacity(spark.createDataFrame(plans, "owner long, plan long, capacity int, generic boolean"), spark.createDataFrame(facts, "owner long, fact long"), got, ["owner"])
    assert {tuple(r) for r in filled.collect()} == more and more


def test_rounds_leave_only_what_is_taken(spark):
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("allocated-*"))
    edges = [(7, 100 + i, 1000 + i + d, 0.99 - 0.01 * (2 * i + d), 1) for i in range(12) for d in (0, 1)]
    got = Z.allocate(spark.createDataFrame(edges, "owner long, plan long, fact long, score double, capacity int"))
    (made,) = set(shared.glob("allocated-*")) - before
    assert {p.name for p in made.glob("round=*/take=*")} == {"take=true"} and len(list(made.glob("round=*"))) > 2
    assert sorted(r.fact for r in got.collect()) == [1000 + i for i in range(12)]


def test_allocation_of_nothing(spark):
    none = spark.createDataFrame([], "owner long, plan long, fact long, score double, capacity int")
    assert Z.allocate(none).count() == 0
    full = spark.createDataFrame([(1, 1, 1, 0.9, 0)], "owner long, plan long, fact long, score double, capacity int")
    assert Z.allocate(full).count() == 0
