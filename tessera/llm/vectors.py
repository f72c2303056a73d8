"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors are compared within their label and length only; below, a label is one such pair.  Equal vectors fall into
one class first, grouped by their values.  A label's classes are dealt to cluster shards around centroids, each class
to its ``OVERLAP`` nearest, so that shards overlap; a shard of more than ``MOST`` classes is split, and so is a
shard's list of queries, so that no task grows with a cluster.  In each shard a flat graph is built by robust pruning
(a neighbour is kept unless one kept before is nearer to it by the factor ``ALPHA``), and the lists of a class from
all its shards are united.

Every class is searched for in the united graph: in its own shards greedily from the medoids to the nearest vectors,
and from those on by range expansion over all neighbours within ``SLACK`` of the range.  Where the expansion meets a
vector that lies in other shards too, it goes on there in the next round, with the ``SEEDS`` nearest such vectors as
starting points, until no search reaches a new shard.  What is found is verified in double precision.  A vector is
counted in its home shard alone, so a task returns one number a query and the links that join its vectors (a star a
component), never all pairs.

Recall is audited: all classes with an id divisible by ``AUDIT_EVERY`` are compared with all classes of their labels
in blocks, and while the share of their links that the graph found is below ``AUDIT`` everything is done again with
more overlap and a wider beam.  Where ``TRIES`` rounds don't reach it, all pairs of a label are compared in blocks of
about ``BLOCK`` classes: that is exact.  ``linked_classes`` returns the measured recall; it is logged, too.

The number of centroids grows with the classes, up to the size of the sample on which they are fitted.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors of null
label or null id, link with nothing and are their own component; equal vectors link with each other; every row
counts as a vector of its own, repeated ones too; different vectors under one id count their own links and share a
component; labels of any type are compared as text; ties in similarity don't matter, as all links in range count;
other columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import stored
from .graph import components, stars

THRESHOLD = 0.98
SHARD, OVERLAP, DEGREE, FAR, ALPHA, BEAM, SLACK, SEEDS = 1500, 3, 24, 6, 1.2, 48, 0.08, 4
#: Classes of a shard, and queries to it, in one task.
MOST, QUERIES, AT_ONCE = 3000, 3000, 128
AUDIT, AUDIT_EVERY, TRIES, BLOCK = 0.99, 20, 3, 3000
#: The bound of the sample that centroids are fitted on, per label.
CENTROID_SAMPLE = 4000


def unit(values) -> np.ndarray:
    m = np.array([np.asarray(v, np.float64) for v in values], np.float64)
    # scaled first, so that very large or small components don't overflow or vanish
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def robust_prune(point: int, found: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Of ``found`` (nearest first), the neighbours of ``point`` to keep."""
    kept: list[int] = []
    to_point = 1 - x[found] @ x[point]
    alive = np.ones(len(found), bool)
    for i in range(len(found)):
        if not alive[i]:
            continue
        kept.append(int(found[i]))
        if len(kept) >= degree:
            break
        alive[i + 1 :] &= alpha * (1 - x[found[i + 1 :]] @ x[found[i]]) > to_point[i + 1 :]
    return kept


def build(x: np.ndarray) -> list[list[int]]:
    """A shard's graph: each vector's nearest ones and a random few, each robustly pruned, with edges both ways.

    The random ones keep tight clusters, whose nearest are all their own, in one graph."""
    n, near = len(x), min(len(x) - 1, 2 * DEGREE)
    rng = np.random.default_rng(n)
    lists: list[list[int]] = [[] for _ in range(n)]
    for s in range(0, n, 512):
        sim = x[s : s + 512] @ x.T
        sim[np.arange(len(sim)), np.arange(s, s + len(sim))] = -2
        if near <= 0:
            continue
        best = np.argpartition(-sim, near - 1, axis=1)[:, :near]
        order = np.take_along_axis(best, np.argsort(-np.take_along_axis(sim, best, axis=1), axis=1, kind="stable"), axis=1)
        for i, found in enumerate(order):
            far = rng.integers(0, n, 2 * FAR)
            far = far[np.argsort(-(x[far] @ x[s + i]), kind="stable")]
            lists[s + i] = robust_prune(s + i, found, x) + robust_prune(s + i, far[far != s + i], x, FAR)
    back: list[list[int]] = [list(v) for v in lists]
    for i, v in enumerate(lists):
        for j in v:
            back[j].append(i)
    return [sorted(set(v)) for v in back]


def medoids(x: np.ndarray, most: int = 8) -> np.ndarray:
    """Where searches begin: the vector nearest to the mean, then each time the one farthest from those before."""
    out = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[out[0]]
    while len(out) < min(most, len(x)):
        out.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[out[-1]])
    return np.unique(out)


@dataclass
class Graph:
    """Unit vectors and the places of each one's neighbours, one list after the other."""

    x: np.ndarray
    ends: np.ndarray
    near: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, lists: list[np.ndarray]) -> Graph:
        ends = np.concatenate(([0], np.cumsum([len(v) for v in lists])))
        return cls(x, ends, np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64))

    def beyond(self, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, neighbour) for every neighbour of each (query, node)."""
        sizes = self.ends[node + 1] - self.ends[node]
        at = np.repeat(self.ends[node] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        return np.repeat(query, sizes), self.near[at]

    def alike(self, q: np.ndarray, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The cosine of each pair; a pair has one value whichever of the two is the query."""
        out = np.empty(len(node))
        for s in range(0, len(node), 1 << 16):
            out[s : s + (1 << 16)] = np.einsum("ij,ij->i", q[query[s : s + (1 << 16)]], self.x[node[s : s + (1 << 16)]])
        return out


def search(g: Graph, q: np.ndarray, seeds: list[np.ndarray], beam: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, node, cosine) of what is within SLACK of the range: greedy searches with a beam from each query's seeds,
    all queries a step at a time, then expansion over everything that is near enough."""
    n, start = len(q), max(map(len, seeds), default=0)
    seen = np.zeros((n, len(g.x)), bool)
    ids, sims, done = np.zeros((n, start), np.int64), np.full((n, start), -2.0), np.ones((n, start), bool)
    for i, s in enumerate(seeds):
        ids[i, : len(s)], sims[i, : len(s)], done[i, : len(s)] = s, g.x[s] @ q[i], False
        seen[i, s] = True
    while True:
        at = np.where(done, -3.0, sims).argmax(axis=1)
        live = np.flatnonzero(~done[np.arange(n), at])
        if not len(live):
            break
        done[live, at[live]] = True
        query, node = g.beyond(live, ids[live, at[live]])
        new = ~seen[query, node]
        query, node = query[new], node[new]
        if not len(node):
            continue
        seen[query, node] = True
        size = np.bincount(query, minlength=n)
        place = np.arange(len(query)) - np.repeat(np.cumsum(size) - size, size)
        width = int(size.max())
        more, close, dull = np.zeros((n, width), np.int64), np.full((n, width), -2.0), np.ones((n, width), bool)
        more[query, place], close[query, place], dull[query, place] = node, g.alike(q, query, node), False
        ids, sims, done = np.concatenate([ids, more], axis=1), np.concatenate([sims, close], axis=1), np.concatenate([done, dull], axis=1)
        if ids.shape[1] > beam:
            keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims, done = (np.take_along_axis(v, keep, axis=1) for v in (ids, sims, done))
    query, k = np.nonzero(sims >= least - SLACK)
    node = ids[query, k]
    walked = np.zeros_like(seen)
    walked[query, node] = True
    out = [(query, node, g.alike(q, query, node))]
    while len(query):
        query, node = g.beyond(query, node)
        new = ~walked[query, node]
        query, node = query[new], node[new]
        if len(query):
            code = np.unique(query * len(g.x) + node)
            query, node = code // len(g.x), code % len(g.x)
            walked[query, node] = True
            close = g.alike(q, query, node)
            near = close >= least - SLACK
            query, node = query[near], node[near]
            out.append((query, node, close[near]))
    query, node, close = (np.concatenate(v) for v in zip(*out, strict=True))
    return query, node, close


#: kind 0: ``b`` linked vectors of the class ``a``; kind 1: a star's link (a, b) of ids; kind 2: the search for the class
#: ``a`` goes on in the shard ``b``.
FOUND = "kind int, a long, b long, label string, seeds array<long>"
_FOUND = [f.split()[0] for f in FOUND.split(", ")]


def _numbers(kind: int, a, b) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, np.int32), "a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64), "label": None, "seeds": None})[_FOUND]


def _shard_graph(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("cls", kind="stable")
    x, cls = unit(pdf["e"].tolist()), pdf["cls"].to_numpy()
    return pd.DataFrame({"cls": cls, "place": pdf["place"].to_numpy(), "near": [cls[v].tolist() for v in build(x)]})


def _shard_search(beam: int, threshold: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The queries ``left`` in the shard ``right``."""
        out = [_numbers(0, [], [])]
        if not len(left) or not len(right):
            return out[0]
        right = right.sort_values("cls", kind="stable")
        cls, rep, weight, home = (right[c].to_numpy() for c in ("cls", "rep", "n", "home"))
        here = int(right["place"].iloc[0])
        find = lambda ids: (p := np.minimum(np.searchsorted(cls, ids), len(cls) - 1))[cls[p] == ids]
        lists = [find(np.asarray(v, np.int64)) for v in right["near"]]
        g = Graph.of(unit(right["e"].tolist()), lists)
        # the other shards of each vector, one list after the other
        others = [np.array([p for p in v if p != here], np.int64) for v in right["places"]]
        sizes = np.array([len(v) for v in others])
        starts, places = np.cumsum(sizes) - sizes, np.concatenate([*others, np.zeros(0, np.int64)])
        first = medoids(g.x)
        for s in range(0, len(left), AT_ONCE):
            part = left.iloc[s : s + AT_ONCE]
            own, own_rep = part["cls"].to_numpy(), part["rep"].to_numpy()
            begin = [np.unique(np.concatenate([first, find(np.asarray(v, np.int64))])) if v is not None and len(v) else first for v in part["seeds"]]
            query, node, close = search(g, unit(part["e"].tolist()), begin, beam, threshold)
            hit = (close >= threshold) & (own[query] != cls[node])
            here_too = hit & home[node]
            out.append(_numbers(0, own, np.bincount(query[here_too], weight[node[here_too]], minlength=len(part)).astype(np.int64)))
            out.append(_numbers(1, *stars(own_rep[query[hit]], rep[node[hit]])))
            # where else the vectors met are to be found
            n = sizes[node]
            to = places[np.repeat(starts[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            if len(to):
                went = pd.DataFrame({"q": np.repeat(query, n), "to": to, "node": np.repeat(node, n), "close": np.repeat(close, n)}).sort_values(["q", "to", "close", "node"], ascending=[True, True, False, True], kind="stable")
                went = went.groupby(["q", "to"], sort=False).head(SEEDS)
                seeds = went.groupby(["q", "to"], sort=False)["node"].agg(list).reset_index()
                out.append(
                    pd.DataFrame({"kind": np.full(len(seeds), 2, np.int32), "a": own[seeds["q"]], "b": seeds["to"].to_numpy(), "label": right["label"].iloc[0], "seeds": [cls[v].tolist() for v in seeds["node"]]})[_FOUND]
                )
        return pd.concat(out, ignore_index=True)

    return run


def _centroids(pdf: pd.DataFrame) -> pd.DataFrame:
    """A label's centroids, by a few rounds of spherical k-means on its sample."""
    pdf = pdf.sort_values("cls", kind="stable")
    x, k = unit(pdf["e"].tolist()), max(1, math.ceil(int(pdf["total"].iloc[0]) * OVERLAP / SHARD))
    k = min(k, len(x))
    c = x[np.random.default_rng(5).choice(len(x), k, replace=False)]
    for _ in range(8 if k > 1 else 0):
        own = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(1e-12, float(np.sqrt(m @ m)))
    return pd.DataFrame({"label": pdf["label"].iloc[0], "shard": np.arange(k), "centre": c.tolist()})


def _assign(classes: DataFrame, centres: DataFrame, overlap: int) -> DataFrame:
    """Each class in the shards of its ``overlap`` nearest centroids, the nearest its home; both sides by label and block."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["label", "cls", "rep", "n", "e"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in [*columns, "shard", "home"]}, dtype=object)
        x, centre = unit(left["e"].tolist()), np.array(right["centre"].tolist()).T
        k = min(overlap, centre.shape[1])
        best = []
        for s in range(0, len(x), 1024):
            sim = x[s : s + 1024] @ centre
            top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
            best.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, axis=1), axis=1, kind="stable"), axis=1))
        out = left.iloc[np.repeat(np.arange(len(left)), k)][columns].reset_index(drop=True)
        out["shard"] = right["shard"].to_numpy()[np.concatenate(best)].ravel()
        out["home"] = np.tile(np.arange(k) == 0, len(left))
        return out

    return classes.groupBy("label", "block").cogroup(centres.groupBy("label", "block")).applyInPandas(nearest, "label string, cls long, rep long, n long, e array<double>, shard int, home boolean")


def _spread(n, at: str = "cls", seed: int = 1):
    """The part of ``n`` that a row falls into."""
    return F.pmod(F.xxhash64(at, F.lit(seed)), n).cast("long")


def _every(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def _blocks(of, size: int):
    return F.ceil(of / size).cast("long")


def _block_links(threshold: float, both_ways: bool):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One block's classes against another's (or their own): how many vectors each is linked with, and stars."""
        out = [_numbers(0, [], [])]
        if len(left) and len(right):
            q, x = unit(left["e"].tolist()), unit(right["e"].tolist())
            (own, rep, n), (own2, rep2, n2) = ([p[c].to_numpy() for c in ("cls", "rep", "n")] for p in (left, right))
            for s in range(0, len(q), 512):
                i, j = np.nonzero(q[s : s + 512] @ x.T >= threshold - 1e-9)
                i += s
                hit = (np.einsum("ij,ij->i", q[i], x[j]) >= threshold) & (own[i] != own2[j])
                i, j = i[hit], j[hit]
                out.append(_numbers(0, *_sums(own[i], n2[j])))
                if both_ways and key[1] != key[2]:
                    out.append(_numbers(0, *_sums(own2[j], n[i])))
                out.append(_numbers(1, *stars(rep[i], rep2[j])))
        return pd.concat(out, ignore_index=True)

    return run


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(key, return_inverse=True)
    return own, np.bincount(at, value, minlength=len(own)).astype(np.int64) if len(own) else own


def true_counts(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): each query class, and how many vectors it is linked with, by comparing with all of its label in blocks."""
    sized = classes.groupBy("label").agg(_blocks(F.count("*"), BLOCK).alias("rights"), F.greatest(_blocks(F.sum(F.col("query").cast("long")), BLOCK), F.lit(1)).alias("lefts"))
    rows = classes.select("label", "cls", "rep", "n", "e", "query").join(sized, "label")
    left = rows.where("query").withColumn("i", _spread(F.col("lefts"))).withColumn("j", _every(F.col("rights")))
    right = rows.withColumn("j", _spread(F.col("rights"))).withColumn("i", _every(F.col("lefts")))
    columns = ["label", "i", "j", "cls", "rep", "n", "e"]
    right = right.select(*[F.col(c).alias(c) for c in columns])
    # a query meets each class of its label once, itself too
    key = ["label", "i", "j"]
    found = left.select(*columns).groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_block_links(threshold, False), FOUND)
    return found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("b"))


def all_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """FOUND rows of all classes of a label, each pair of blocks in a task of its own."""
    sized = classes.groupBy("label").agg(_blocks(F.count("*"), BLOCK).alias("blocks"))
    own = classes.select("label", "cls", "rep", "n", "e").join(sized, "label").withColumn("own", _spread(F.col("blocks"), seed=7))
    columns = ["label", "i", "j", "cls", "rep", "n", "e"]
    left = own.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)))
    right = own.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("own"))))
    right = right.select(*[F.col(c).alias(c) for c in columns])
    return left.select(*columns).groupBy("label", "i", "j").cogroup(right.groupBy("label", "i", "j")).applyInPandas(_block_links(threshold, True), FOUND)


def united_graph(classes: DataFrame, overlap: int) -> tuple[DataFrame, DataFrame]:
    """The graph (label, place, cls, rep, n, e, home, near, places), a row for each class in each of its shards, and
    the first visits (label, place, cls, rep, e, seeds): every class in all parts of its shards."""
    sized = classes.groupBy("label").agg(F.count("*").alias("total"))
    rows = classes.join(sized, "label")
    # a sample of fixed size a label, those whose hashes are lowest: taken by a threshold on the hash, not by a sort of the label
    share = F.greatest(F.lit(1.0), F.col("total") / CENTROID_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < F.lit(float(1 << 30)) / share)
    centres = stored(sample.select("label", "cls", "e", "total").groupBy("label").applyInPandas(_centroids, "label string, shard int, centre array<double>"), "centres")
    blocks = _blocks(F.col("total"), 8 * BLOCK)
    every_block = centres.join(sized, "label").select("label", "shard", "centre", _every(blocks).alias("block"))
    assigned = stored(_assign(rows.withColumn("block", _spread(blocks)), every_block, overlap), "assigned")
    parts = assigned.groupBy("label", "shard").agg(_blocks(F.count("*"), MOST).alias("parts"))
    assigned = assigned.join(parts, ["label", "shard"])
    place = lambda part: F.col("shard") * F.lit(1 << 32) + part
    placed = stored(assigned.withColumn("place", place(_spread(F.col("parts"), seed=3))).drop("shard", "parts"), "placed")
    lists = placed.select("label", "place", "cls", "e").groupBy("label", "place").applyInPandas(_shard_graph, "cls long, place long, near array<long>")
    united = lists.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("place").alias("places"))  # at most overlap lists
    graph = stored(placed.join(united, "cls"), "graph")
    visits = assigned.select("label", "shard", "cls", "rep", "e", _every(F.col("parts")).alias("part"))
    return graph, visits.select("label", place(F.col("part")).alias("place"), "cls", "rep", "e", F.lit(None).cast("array<long>").alias("seeds"))


def search_all(classes: DataFrame, overlap: int, beam: int, threshold: float) -> DataFrame:
    """FOUND rows of kinds 0 and 1, by searching the united graph for every class."""
    graph, visits = united_graph(classes, overlap)
    visits = stored(visits, "visits")
    been, found = visits.select("cls", "place"), None
    while True:
        blocks = stored(visits.groupBy("label", "place").agg(_blocks(F.count("*"), QUERIES).alias("blocks")), "blocks")
        left = visits.join(blocks, ["label", "place"]).withColumn("block", _spread(F.col("blocks"), seed=5))
        right = graph.join(blocks, ["label", "place"]).withColumn("block", _every(F.col("blocks")))
        key = ["label", "place", "block"]
        got = left.select(*key, "cls", "rep", "e", "seeds").groupBy(*key).cogroup(right.select(*key, "cls", "rep", "n", "e", "home", "near", "places").groupBy(*key)).applyInPandas(_shard_search(beam, threshold), FOUND)
        got = stored(got, "found")
        found = got.where("kind < 2") if found is None else found.union(got.where("kind < 2"))
        on = got.where("kind = 2").groupBy(F.col("a").alias("cls"), F.col("b").alias("place"), "label").agg(F.array_distinct(F.flatten(F.collect_list("seeds"))).alias("seeds"))
        on = stored(on.join(been, ["cls", "place"], "left_anti"), "onward")
        if on.limit(1).count() == 0:
            return found
        visits = stored(on.join(classes.select("cls", "rep", "e"), "cls").select("label", "place", "cls", "rep", "e", "seeds"), "visits")
        been = been.union(visits.select("cls", "place"))


def linked_classes(classes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float, bool]:
    """FOUND rows of kinds 0 and 1 for classes (label, cls, rep, n, e, query); the audited recall, and whether the graph
    reached it (else all pairs were compared)."""
    truth = stored(true_counts(classes, threshold), "truth")
    wanted = truth.agg(F.sum("b")).first()[0] or 0
    overlap, beam, recall = OVERLAP, BEAM, 1.0
    for _ in range(TRIES):
        found = search_all(classes, overlap, beam, threshold)
        got = found.where("kind = 0").join(truth.select("a"), "a", "left_semi").agg(F.sum("b")).first()[0] or 0
        recall = got / wanted if wanted else 1.0
        logging.getLogger(__name__).info("recall %.4f of %d links, overlap %d, beam %d", recall, wanted, overlap, beam)
        if recall >= AUDIT:
            return found, recall, True
        overlap, beam = 2 * overlap, 2 * beam
    return stored(all_pairs(classes, threshold), "found"), recall, False


def near_duplicate_vectors(df: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row."""
    ship(df.sparkSession)
    e = F.col("e")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    given = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("e"))
    fit = F.coalesce((F.size(e) > 0) & ~F.exists(e, bad) & F.exists(e, lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    base = stored(given.withColumn("fit", fit), "vectors")
    ok = base.where("fit").select("id", F.concat_ws(":", F.size("e").cast("string"), "label").alias("label"), "e")
    classes = ok.groupBy("label", "e").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.max(F.col("id") % AUDIT_EVERY == 0).alias("query"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    found, _, _ = linked_classes(classes, threshold)
    others = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("others"))
    label_of = components(found.where("kind = 1"))
    of_class = classes.select("label", "e", "cls", "n", "rep").join(others, "cls", "left").join(label_of.select("node", F.col("label").alias("least")), F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("label", "e", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = ok.join(of_class, ["label", "e"]).select("id", "n_links", "component_id")
    rest = base.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(rest).select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
