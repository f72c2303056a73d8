"""Sharding, near-duplicates, vectors and mixing against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import graph, mixing, neardup, sharding, vectors
from tessera.llm.shingles import shingle_sets


def _components(nodes, links):
    p = {n: n for n in nodes}

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_shingles_equal_the_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one TWO", "a\x0bb c", "É é"] + [" ".join(rng.choice(["a", "B", "c", "dd"]) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    for k in (1, 2, 5):
        values, starts = shingle_sets(texts, k)
        brute, hashed = [], []
        for i, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            brute.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
            hashed.append(frozenset(values[starts[i] : starts[i + 1]].tolist()))
        for a in range(len(texts)):
            for b in range(a + 1):
                assert len(brute[a] & brute[b]) == len(hashed[a] & hashed[b])


def _brute_neardup(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        own = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())
        sets.setdefault(i, set()).add(own)
    links = [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    return _components([i for i in sets if i is not None], links)


@pytest.mark.parametrize(("k", "seed"), [(2, 1), (5, 2)])
def test_near_duplicates_equal_brute_force(spark, k, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))] for _ in range(60)]
    rows = []
    for i in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "one"), (2004, "ONE"), (2005, "one two"), (None, "one two"), rows[5], rows[5], (2006, "long " * 50_000), (2007, "long " * 60_000)]
    got = neardup.near_duplicates(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, component_id int"), k=k, threshold=80).collect()
    truth = _brute_neardup(rows, k, 80)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == truth.get(r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert next(r for r in got if r.doc_id == 2000).n_shingles == 0


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.kept for r in neardup.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [True]


def _python_nodes(plan: str) -> int:
    """The most Python nodes of a plan that one task runs, and so the workers that it holds."""
    most, path = 0, []
    for line in plan.splitlines():
        if (node := re.search(r"[A-Za-z]", line)) is None:
            continue
        while path and path[-1][0] >= node.start():
            path.pop()
        below = path[-1][1] if path else 0
        kind = line[node.start() :]
        n = 0 if re.match(r"\w*(Exchange|QueryStage)", kind) else below + bool(re.match(r"\w*(Python|InPandas|Pandas)\b", re.sub(r"^\*?\(\d+\) ", "", kind)))
        path.append((node.start(), n))
        most = max(most, n)
    return most


def test_a_task_of_near_duplicates_holds_one_python_worker(spark, monkeypatch):
    """An executor keeps as many workers as ever ran at once, beside the next queries' memory."""
    plans = []

    def planned(df, label, write=neardup.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(neardup, "stored", planned)
    monkeypatch.setattr(graph, "stored", planned)
    rows = [(i, " ".join(f"w{i // 4}x{j}" for j in range(60)) + f" end{i}") for i in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.where("kept").collect()} == set(range(0, 40, 4))
    counts = [_python_nodes(p) for p in plans]
    assert max(counts) == 1 and sum(counts) >= 5



def test_partition_edges_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ROWS_A_PARTITION", 400)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        w[rng.randrange(60)] = "x"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    assert {r.component_id for r in got.collect()} == set(_brute_neardup(rows, 2, 80).values())


def test_dense_regions_lose_no_link(spark, monkeypatch):
    """More classes in a bucket than meet in the first pass: many of one component, some of others, some alone."""
    monkeypatch.setattr(neardup, "ROWS_A_PARTITION", 3000)
    monkeypatch.setattr(neardup, "BLOCK", 10_000)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for g in range(4):
        own = list(base)
        for j in range(0, 80, 80 // (3 * g + 1)):
            own[j] = f"g{g}"
        for i in range(120):
            w = list(own)
            for _ in range(rng.choice([1, 2, 4, 7, 9])):
                w[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    truth = _brute_neardup(rows, 2, 80)
    assert len(set(truth.values())) > 20
    assert {r.doc_id: r.component_id for r in got} == truth


def test_texts_of_one_id_and_names_that_clash(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a + " z"), (5, b), (9, b + " z"), (9, b + " z"), (7, c), (None, c)]
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], "doc_id long, text string, id int, rep int, label string")
    got = neardup.near_duplicates(df, k=2)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((r.doc_id, r.component_id) for r in got.where("doc_id is not null").collect()) == [(1, 1), (5, 1), (5, 1), (7, 7), (9, 1), (9, 1)]
    assert got.where("doc_id is null").collect()[0].kept


def test_long_words_keep_their_difference():
    """Thue-Morse words and their complements: a polynomial modulo 2^64 can't tell them apart."""
    t = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)
    values, starts = shingle_sets([one, other], 2)
    assert values[starts[0]] != values[starts[1]]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got.values()) == {1, 100} and len(got) == 62


# Sharding


def test_sharding_by_bytes(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 400)) for i in range(3000)] + [(3000, None), (None, "x"), (None, "x")] + [(77, "same")] * 500
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, size int")
    got = sharding.assign_shards(sharding.digests(df), 24).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(24))
    totals = [sum(r["size"] for r in v) for v in by.values()]
    assert max(totals) <= 1.01 * min(totals)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    assert sharding.assign_shards(sharding.digests(df.limit(0)), 24).count() == 0


def test_rebalancing_moves_little(spark, tmp_path):
    rng = random.Random(3)
    weights = {s: rng.randint(1, 100) for s in range(2000)}
    old = sharding.plan(weights, 24)
    new = sharding.rebalance(old, weights, 25)
    load = defaultdict(int)
    for s, shard in new.items():
        load[shard] += weights[s]
    assert len(load) == 25 and max(load.values()) <= 1.05 * min(load.values())
    assert sum(weights[s] for s in new if old[s] != new[s]) < 0.06 * sum(weights.values())
    assert sharding.rebalance(old, weights, 24) == old
    path = str(tmp_path / "map")
    sharding.write_map(spark, path, 1, old)
    sharding.write_map(spark, path, 2, new)
    assert {r.version: r["n"] for r in spark.read.parquet(path).groupBy("version").agg(F.count("*").alias("n")).collect()} == {1: 2000, 2: 2000}
    with pytest.raises(ValueError):
        sharding.write_map(spark, path, 2, old)


def test_a_stored_map_is_edited_not_replaced(spark, tmp_path):
    path, sf = str(tmp_path / "map"), "/root/testdata/sf0.001"
    first = {r.doc_id: r for r in sharding.op2_sharding(spark, sf, path).collect()}
    again = {r.doc_id: r for r in sharding.op2_sharding(spark, sf, path).collect()}
    assert again == first and {r.map_version for r in first.values()} == {1} and sharding.versions(spark, path) == [1]
    grown = {r.doc_id: r for r in sharding.op2_sharding(spark, sf, path, 25).collect()}
    assert sharding.versions(spark, path) == [1, 2] and {r.map_version for r in grown.values()} == {2}
    one, two = sharding.read_map(spark, path, 1), sharding.read_map(spark, path, 2)
    assert len(one) == len(two) == sharding.SLOTS and all(two[grown[i].vslot] == grown[i].shard and one[first[i].vslot] == first[i].shard for i in first)
    moved = sum(first[i].size for i in first if first[i].shard != grown[i].shard)
    assert 0 < moved < 0.2 * sum(r["size"] for r in first.values()) and len({r.shard for r in grown.values()}) == 25


def test_sharding_query(spark):
    """Against the contract, by plain Python."""
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    df = sharding.op2_sharding(spark, "/root/testdata/sf0.001")
    assert df.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id]), "bytes", None)
    for shard in range(24):
        places = sorted(r.slot for r in rows if r.shard == shard)
        assert places == list(range(len(places)))


# Vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(700):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.08, 0.5])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3)))
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # equal vectors
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0] * 15 + [None], 1), (2004, rows[4][1], None), (2005, [float("inf")] * 16, 1), (2006, [], 1), (2007, [1.0, 2.0], 0), (2008, [2 * x for x in rows[3][1]], rows[3][2]), (None, rows[3][1], rows[3][2])]
    got = {r.vec_id: r for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and (i < 2000 or i == 2008)]
    links = []
    counts = defaultdict(int)
    for a in range(len(usable)):
        for b in range(a + 1, len(usable)):
            if usable[a][2] == usable[b][2] and usable[a][1] @ usable[b][1] >= 0.98:
                links.append((usable[a][0], usable[b][0]))
                counts[usable[a][0]] += 1
                counts[usable[b][0]] += 1
    truth = _components([r[0] for r in rows], links)
    assert len(links) > 500
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (counts[i], truth[i], truth[i] == i)


def test_vectors_are_compared_in_blocks_where_the_graph_misses_links(spark, monkeypatch):
    monkeypatch.setattr(vectors, "search_all", lambda classes, *_: classes.sparkSession.createDataFrame([], vectors.FOUND))
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "TRIES", 1)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.03 * rng.normal(size=8)], i % 2) for i in range(200)]
    got = {r.vec_id: r.n_links for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    alike = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    assert got == {i: int(alike[i].sum()) - 1 for i in range(200)} and alike.sum() > 1000


def test_vectors_of_a_rarer_length_link_too(spark):
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0), (3, [-1.0, 2.0, 3.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.0], 0), (6, [1.0, 2.001], 0), (7, [1.0, 2.0], 1), (8, [1.0, 2.0], -1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4), 7: (0, 7), 8: (0, 8)}


def test_a_dense_cluster_over_several_shards(spark, monkeypatch):
    """One group of similar vectors that is larger than a shard's parts; every link is counted once."""
    monkeypatch.setattr(vectors, "SHARD", 300)
    monkeypatch.setattr(vectors, "MOST", 150)
    monkeypatch.setattr(vectors, "QUERIES", 100)
    rng = np.random.default_rng(13)
    centre = rng.normal(size=24)
    x = np.concatenate([centre + 0.1 * rng.normal(size=(1200, 24)), rng.normal(size=(300, 24))])
    rows = [(i, [float(y) for y in v], "x") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(df).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    alike = x @ x.T >= 0.98
    np.fill_diagonal(alike, False)
    counts = alike.sum(axis=1)
    truth = _components(range(len(rows)), zip(*np.nonzero(alike), strict=True))
    assert counts.max() > 400
    assert sum(n for n, _ in got.values()) >= vectors.AUDIT * counts.sum() and all(got[i][0] <= counts[i] for i in got)
    assert {i: c for i, (_, c) in got.items()} == truth


def test_recall_is_audited_and_reported(spark):
    rng = np.random.default_rng(14)
    x = np.repeat(rng.normal(size=(60, 12)), 10, axis=0) + 0.02 * rng.normal(size=(600, 12))
    classes = spark.createDataFrame([("12:1", i, i, 1, [float(y) for y in v], i % 20 == 0) for i, v in enumerate(x)], "label string, cls long, rep long, n long, e array<double>, query boolean")
    found, recall, by_graph = vectors.linked_classes(classes)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    truth = (x @ x.T >= 0.98).sum(axis=1) - 1
    got = {r.a: r.b for r in found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("b")).collect()}
    queries = range(0, 600, 20)
    assert recall == sum(got[i] for i in queries) / sum(truth[i] for i in queries) and recall >= vectors.AUDIT and by_graph


def test_no_vectors(spark):
    assert vectors.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# Mixing


def _mixed_corpus(rng):
    kinds = {0: "good plain fine nice".split(), 1: "junk spam bad noise".split(), 2: "awful rude nasty mean".split()}
    docs, labels = [], []
    for i in range(600):
        k = rng.choices([0, 1, 2], [8, 1, 1])[0]
        docs.append((i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randint(5, 60)))))
        labels.append((i, int(k != 1), int(k == 2)))
    return docs, labels


def test_rates_meet_targets(spark):
    docs, labels = _mixed_corpus(random.Random(6))
    docs += [(700, None), (701, ""), (None, "good fine"), docs[0], (702, "word " * 50_000)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = mixing.train(df, known)
    scored = mixing.posteriors(df, model).cache()
    for r in scored.collect():
        assert abs(sum(r.posterior) - 1) < 1e-9
    rated, targets, reached = mixing.fit_rates(scored)
    assert all(abs(a - b) <= 1e-3 * sum(targets) for a, b in zip(targets, reached, strict=True))
    rows = rated.collect()
    assert len(rows) == len(docs) and all(r.rate >= 0 for r in rows)
    totals = [sum(r.rate * r.tokens * r.posterior[d] for r in rows) for d in range(3)]
    assert totals == pytest.approx(reached, rel=1e-6)
    # an independent solver of the same least-squares problem comes no closer
    a = np.array([[r.tokens * r.posterior[d] for r in rows] for d in range(3)])
    assert np.abs(a @ np.array([r.rate for r in rows]) - targets).max() <= 1e-3 * sum(targets)


def test_weights_are_met_whole(spark):
    """A rare domain has to grow beyond twice its size: shares are those asked for, in rates and in copies' expectation."""
    docs, labels = _mixed_corpus(random.Random(8))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    asked = (0.3, 0.1, 0.6)
    rows = mixing.mix(df, known, asked).collect()
    now = [sum(r.tokens * r.posterior[d] for r in rows) for d in range(3)]
    totals = [sum(r.rate * r.tokens * r.posterior[d] for r in rows) for d in range(3)]
    assert asked[2] * sum(now) > 2 * now[2]
    assert [t / sum(totals) for t in totals] == pytest.approx(asked, abs=1e-3)
    assert sum(totals) == pytest.approx(sum(now), rel=1e-3)


def test_down_weighting_stays_nonnegative(spark):
    docs, labels = _mixed_corpus(random.Random(7))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = mixing.posteriors(df, mixing.train(df, known)).cache()
    now = [sum(r.tokens * r.posterior[d] for r in scored.collect()) for d in range(3)]
    rated, targets, reached = mixing.fit_rates(scored, targets=[now[0], 0.2 * now[1], 0.3 * now[2]])
    rows = rated.collect()
    assert all(r.rate >= 0 for r in rows)
    # all that an independent solver gains in many more steps
    a = np.array([[r.tokens * r.posterior[d] for r in rows] for d in range(3)])
    x = np.ones(len(rows))
    step = 1 / np.linalg.eigvalsh(a @ a.T).max()
    for _ in range(20_000):
        x = np.maximum(0, x - step * a.T @ (a @ x - targets))
    best, own, start = (np.square(np.array(v) - targets).sum() for v in (a @ x, reached, now))
    assert own <= best + 0.01 * (start - best)


def test_heat_has_the_least_held_out_loss(spark):
    docs, labels = _mixed_corpus(random.Random(9))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.train(df, known)
    held = df.join(known, "doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(mixing.HOLDOUT)) == 0).withColumn("domain", mixing.domain_of(F.col("quality"), F.col("toxic")))

    def loss(heat):
        rows = mixing.posteriors(held, mixing.replace(model, heat=heat)).collect()
        return float(np.mean([-np.log(r.posterior[r.domain]) for r in rows]))

    assert model.loss == pytest.approx(loss(model.heat), rel=1e-6)
    assert all(model.loss <= loss(h) + 1e-9 for h in mixing.HEATS[::4])


def test_posteriors_equal_the_regression(spark):
    """Features, sums and softmax by hand, for texts with nulls, ties of case, marks and repeated words."""
    docs, labels = _mixed_corpus(random.Random(12))
    docs += [(-1, None), (-2, ""), (-3, "### " + " ".join(w.upper() for w in docs[0][1].split()) + " !!"), (-4, docs[0][1] * 50)]
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.train(df, known)
    assert model.odds
    for r in mixing.posteriors(df, model).collect():
        low = (r.text or "").lower()
        found = set(re.split(r"[\W\d_]+", low)) | set(re.split(r"[^\W_]+|[ \t\n\x0b\f\r]+", low))
        z = np.array(model.prior) + sum((np.array(model.odds[f]) for f in found if f in model.odds), np.zeros(3))
        p = np.exp(z / model.heat - (z / model.heat).max())
        assert r.posterior == pytest.approx((p / p.sum()).tolist(), abs=1e-9) and r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))


def test_mixing_leaves_out_no_more_than_asked(spark):
    rows = mixing.op7_mixing(spark, "/root/testdata/sf0.01").collect()
    assert rows[0].reached_tokens == pytest.approx(rows[0].asked_tokens, rel=2e-2) and rows[0].effective_share > 0.8
    assert sum(r.copies == 0 for r in rows) < 0.15 * len(rows)


def test_mixing_replaces_columns_of_its_results(spark):
    docs, labels = _mixed_corpus(random.Random(10))
    df = spark.createDataFrame([(*d, -1, "x", "y") for d in docs[:50] + docs[:2]], "doc_id long, text string, tokens int, posterior string, rate string")
    rows = mixing.mix(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 52 and all(r.tokens == len(r.text.split()) and len(r.posterior) == 3 and r.rate >= 0 for r in rows)


def test_copies_average_the_rate(spark):
    df = spark.range(20_000).select("id", F.lit(1.3).alias("rate"))
    n = df.select(F.sum(mixing.copies(F.col("rate"), F.col("id")))).first()[0]
    assert abs(n / 20_000 - 1.3) < 0.02


def test_mixing_of_nothing(spark):
    empty, none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix(empty, none).count() == 0
    one = mixing.mix(spark.createDataFrame([(1, None)], "doc_id long, text string"), none).collect()
    assert one[0].rate == 1 and one[0].tokens == 0
