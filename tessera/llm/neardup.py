"""Near-duplicate documents by an LSH forest over word shingles.

Texts with equal shingle sets (equal in size and in 128 bits of digest) fall into one class first, so that
thousands of copies are one node, named by its least id.  Each class has ``TREES`` labels of ``DEPTH`` minhash
values; every tree is one sorted order of its labels.  In an order, a class's candidates are the classes that
share a label prefix of ``LEAST`` values or more, its bucket; a 256-bit sketch of the set rules out those that are
far apart (over ``SKETCH_ERRORS`` standard errors under the threshold).

The depth adapts to the region.  In a bucket of up to ``REACH`` + 1 classes all are compared.  In a denser one
(and in one that lies on a partition's edge) each class first meets its nearest neighbours by longest common
prefix, ``EMIT`` of the ``REACH`` that follow it, and the bucket's rows are set aside.  Once the links found so have
been confirmed and their components are known, the rows set aside are gone through exactly: buckets that share a
class make a region, and a region's classes outside its commonest component are compared with all of the region on
their full shingle sets, by an inverted index, block by block.  What comes out is a star of links a component, never
all pairs.  So no candidate is lost to a limit; a region of many classes that are alike, but under the threshold,
costs up to the square of their number in these blocks.

Candidates are confirmed on full shingle sets: first the most voted partner of each class, then every
pair that still joins two components.  Links within a component need no confirming, since they'd not
change it.

The orders are range-partitioned by (tree, label, class), so that equal labels by the thousand spread over
partitions.

Defined results: a text that is null or without words has the empty set, is linked with nothing and is
its own component; a text of fewer than k words has one shingle, its whole sequence; repeated rows
fall into one class; different texts under one id are one node, linked by any of them; a null id gets component
null and is kept; of ties in votes the least id is confirmed first, which changes no component; a very long text
is one set like any other; other columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import ship
from .common import stored
from .graph import components, stars
from .shingles import minhashes, overlap, set_digests, shingle_sets

TREES, DEPTH, LEAST, REACH, EMIT = 20, 6, 4, 64, 6
SKETCH_BITS, SKETCH_ERRORS = 256, 5
ROWS_A_PARTITION = 100_000
#: Shingles of a dense region in one task, on either side.
BLOCK = 1 << 22

SIGNATURE = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("cls2", T.LongType()), T.StructField("labels", T.BinaryType()), T.StructField("sketch", T.BinaryType())]
)


def signatures(df: DataFrame, k: int, text: str = "text") -> DataFrame:
    """``df`` with ``sig``: set size, class (128 bits of the whole set), the trees' labels, and the sketch."""
    ship(df.sparkSession)

    @F.pandas_udf(SIGNATURE)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        given = [t if isinstance(t, str) else None for t in texts]
        step = max(1, min(2000, (8 << 20) // max(1, sum(map(len, filter(None, given))) // max(1, len(given)))))
        for s in range(0, len(given), step):
            values, starts = shingle_sets(given[s : s + step], k)
            hashed = minhashes(values, starts, TREES * DEPTH + SKETCH_BITS // 2)
            labels = hashed[:, : TREES * DEPTH].astype(">u2")
            # two bits from each further minhash
            rest = hashed[:, TREES * DEPTH :]
            sketch = np.packbits(np.concatenate([rest & 1, (rest >> 1) & 1], axis=1).astype(np.uint8), axis=1)
            cls, cls2 = set_digests(values, starts)
            rows += [(n, c, d, x.tobytes(), y.tobytes()) for n, c, d, x, y in zip(np.diff(starts).tolist(), cls.tolist(), cls2.tolist(), labels, sketch, strict=True)]
        return pd.DataFrame(rows, columns=SIGNATURE.fieldNames())

    return df.withColumn("sig", of(F.col(text)))


#: kind 0: a candidate pair (a, b); kind 1: a row ``a`` of a dense bucket, and the first one of it in its partition.
FOUND = "kind int, a long, b long, tree int, prefix binary"
_FOUND = [f.split()[0] for f in FOUND.split(", ")]


def _far(threshold: int) -> int:
    """Differing sketch bits beyond which a pair is out, for a similarity of ``threshold`` percent."""
    p = (1 - threshold / 100) / 2  # chance that a bit differs
    # the two bits of one minhash agree or not together, in part: count each minhash once for the error
    return math.ceil(SKETCH_BITS * p + SKETCH_ERRORS * SKETCH_BITS * math.sqrt(p * (1 - p) / (SKETCH_BITS / 2)))


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of sketches as rows of 64-bit words."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _close(n: np.ndarray, m: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= threshold * np.maximum(n, m)


class Rows:
    """Rows of an order as arrays; ``seen`` of them, at the front, have met one another before, in a bucket whose first
    row was ``head``."""

    def __init__(self, tree: np.ndarray, label: np.ndarray, rep: np.ndarray, n: np.ndarray, sketch: np.ndarray, seen: int = 0, head: int | None = None) -> None:
        self.tree, self.label, self.rep, self.n, self.sketch, self.seen, self.head = tree, label, rep, n, sketch, seen, head

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Rows:
        label = np.frombuffer(b"".join(pdf["label"]), np.uint8).reshape(len(pdf), 2 * DEPTH)
        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), SKETCH_BITS // 64)
        return cls(pdf["tree"].to_numpy(), label, pdf["rep"].to_numpy(), pdf["n"].to_numpy(), sketch)

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.tree, self.label, self.rep, self.n, self.sketch

    def part(self, a: int, b: int | None = None, seen: int = 0, head: int | None = None) -> Rows:
        return Rows(*[c[a:b] for c in self.columns()], seen=seen, head=head)

    def after(self, before: Rows | None) -> Rows:
        return self if before is None else Rows(*map(np.concatenate, zip(before.columns(), self.columns(), strict=True)), seen=before.seen, head=before.head)

    def __len__(self) -> int:
        return len(self.rep)

    def buckets(self) -> np.ndarray:
        """The place of each row's bucket."""
        out = np.zeros(len(self), np.int64)
        if len(self) > 1:
            out[1:] = np.cumsum((self.tree[1:] != self.tree[:-1]) | (self.label[1:, : 2 * LEAST] != self.label[:-1, : 2 * LEAST]).any(axis=1))
        return out


def neighbours(rows: Rows, of: np.ndarray, dense: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (by place) of sorted rows: all of a bucket, but in dense ones EMIT of the REACH rows that follow."""
    far, out = _far(threshold), [(np.zeros(0, np.int64),) * 2]
    left = np.where(dense[of], EMIT, REACH)
    active = np.arange(len(rows))
    for off in range(1, REACH + 1):
        active = active[active + off < len(rows)]
        active = active[(of[active] == of[active + off]) & (left[active] > 0)]
        if not len(active):
            break
        i, j = active, active + off
        ok = _close(rows.n[i], rows.n[j], threshold) & (rows.rep[i] != rows.rep[j]) & (j >= rows.seen)
        i, j = i[ok], j[ok]
        near = _differing(rows.sketch[i], rows.sketch[j]) <= far
        i, j = i[near], j[near]
        left[i] -= 1
        out.append((i, j))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return i, j


def _scan(threshold: int, alone: bool):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidate pairs of a sorted partition, and the rows of its dense buckets and of those at its edges."""

        def worked(rows: Rows, more: bool, edges: tuple[bool, bool]) -> Iterator[pd.DataFrame]:
            """``more``: the last bucket is dense and goes on; ``edges``: the first, the last bucket is at the partition's edge."""
            of = rows.buckets()
            size = np.bincount(of)
            dense = size > REACH + 1
            dense[-1] |= more
            dense[0] |= rows.seen > 0
            i, j = neighbours(rows, of, dense, threshold)
            a, b = rows.rep[i], rows.rep[j]
            yield pd.DataFrame({"kind": np.zeros(len(a), np.int32), "a": np.minimum(a, b), "b": np.maximum(a, b), "tree": None, "prefix": None})[_FOUND]
            aside = dense.copy()
            if not alone:
                aside[0] |= edges[0]
                aside[-1] |= edges[1]
            heads = rows.rep[np.searchsorted(of, np.arange(len(size)))]
            if rows.head is not None:
                heads[0] = rows.head
            at = np.flatnonzero(aside[of])
            at = at[at >= rows.seen]
            for s in range(0, len(at), 10_000):
                p = at[s : s + 10_000]
                yield pd.DataFrame({"kind": np.ones(len(p), np.int32), "a": rows.rep[p], "b": heads[of[p]], "tree": rows.tree[p], "prefix": [x.tobytes() for x in rows.label[p, : 2 * LEAST]]})[_FOUND]

        kept, first = None, True
        for pdf in batches:
            if not len(pdf):
                continue
            rows = Rows.of(pdf).after(kept)
            of = rows.buckets()
            last = int(np.searchsorted(of, of[-1]))  # where the last bucket begins
            if last:
                yield from worked(rows.part(0, last, rows.seen, rows.head), False, (first, False))
                first, rows = False, rows.part(last)
            if len(rows) > 4 * REACH:  # dense: no need to wait for its end
                yield from worked(rows, True, (first, False))
                rows = rows.part(len(rows) - REACH, seen=REACH, head=int(rows.rep[0]) if rows.head is None else rows.head)
            kept = rows
        if kept is not None:
            yield from worked(kept, False, (first, True))

    return scan


def forest(classes: DataFrame, threshold: int) -> DataFrame:
    """FOUND rows: candidate pairs of classes (rep, n, labels, sketch), and the rows of dense buckets."""
    width = 2 * DEPTH
    rows = classes.select("rep", "n", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "labels")
    rows = rows.select("tree", F.expr(f"substring(labels, 1 + tree * {width}, {width})").alias("label"), "rep", "n", "sketch")
    parts = max(1, math.ceil(classes.count() * TREES / ROWS_A_PARTITION))
    order = ["tree", "label", "rep"]
    ranged = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    return stored(ranged.sortWithinPartitions(*order).mapInPandas(_scan(threshold, parts == 1), FOUND), "forest")


def _exact(k: int, threshold: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The links of ``left`` with ``right``, two blocks of a region, as stars."""
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        if len(left) and len(right):
            values, starts = shingle_sets(right["text"].tolist(), k)
            of = np.repeat(np.arange(len(right)), np.diff(starts))
            order = np.argsort(values, kind="stable")
            values, of, size = values[order], of[order], np.diff(starts)
            own, begin = shingle_sets(left["text"].tolist(), k)
            one, other = left["a"].to_numpy(), right["a"].to_numpy()
            a, b, held = [], [], 0
            for i in range(len(left)):
                x = own[begin[i] : begin[i + 1]]
                lo, n = np.searchsorted(values, x), np.searchsorted(values, x, "right")
                n -= lo
                both = np.bincount(of[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(right))
                hit = np.flatnonzero((both > 0) & (100 * both >= threshold * (len(x) + size - both)))
                a.append(np.full(len(hit), one[i]))
                b.append(other[hit])
                held += len(hit)
                if held > 1 << 20 or i + 1 == len(left):
                    out.append(pd.DataFrame(dict(zip("ab", stars(np.concatenate(a), np.concatenate(b)), strict=True))))
                    a, b, held = [], [], 0
        return pd.concat(out)

    return run


def regions(dense: DataFrame) -> DataFrame:
    """(node, region): the classes of dense buckets; those of one bucket are in one region."""
    heads = dense.select("tree", "prefix", "b").distinct()
    pieces = heads.groupBy("tree", "prefix").agg(F.min("b").alias("least"), F.count("*").alias("c")).where("c > 1")
    apart = heads.join(pieces, ["tree", "prefix"]).select(F.col("least").alias("a"), "b")
    return components(dense.select("a", "b").union(apart)).withColumnRenamed("label", "region")


def across_components(dense: DataFrame, labels: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """(a, b): links that join the components ``labels`` (node, label) of dense buckets' classes, as stars.

    Classes of a region's commonest component meet only the region's other classes.  ``sizes``: (id, n) of classes;
    ``texts``: (id, text).
    """
    rows = regions(dense).join(labels, "node", "left").select(F.col("node").alias("a"), "region", F.coalesce("label", "node").alias("label"))
    rows = stored(rows.join(sizes.withColumnRenamed("id", "a"), "a"), "dense")
    counts = rows.groupBy("region", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    split = counts.groupBy("region").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("c", "label", "n")).alias("most")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    split = split.select("region", F.col("most.label").alias("major"), blocks(F.col("all")).alias("rights"), blocks(F.col("all") - F.col("most.n")).alias("lefts"))
    mixed = stored(rows.join(split, "region").drop("n").hint("merge").join(texts.withColumnRenamed("id", "a"), "a"), "dense-texts")
    block = lambda n: F.pmod(F.xxhash64("a"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key = ["region", "i", "j"]
    left = mixed.where("label <> major").withColumn("i", block(F.col("lefts"))).withColumn("j", every(F.col("rights"))).select(*key, "a", "text")
    right = mixed.withColumn("j", block(F.col("rights"))).withColumn("i", every(F.col("lefts"))).select(*[F.col(c).alias(c) for c in (*key, "a", "text")])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_exact(k, threshold), "a long, b long")


def _confirmer(k: int, threshold: int):
    @F.pandas_udf(T.BooleanType())
    def confirmed(one: pd.Series, other: pd.Series) -> pd.Series:
        out = []
        for s in range(0, len(one), 200):
            texts = [*one[s : s + 200], *other[s : s + 200]]
            values, starts = shingle_sets(texts, k)
            sets = [values[x:y] for x, y in zip(starts[:-1], starts[1:], strict=True)]
            for x, y in zip(sets[: len(sets) // 2], sets[len(sets) // 2 :], strict=True):
                both = overlap(x, y)
                out.append(bool(100 * both >= threshold * (len(x) + len(y) - both)))
        return pd.Series(out, dtype=bool)

    return confirmed


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs whose full shingle sets are alike enough; an id's texts are each compared."""
    one, other = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(one, "a").join(other, "b").where(_confirmer(k, threshold)(F.col("text_a"), F.col("text_b"))).select(*pairs.columns)


def near_duplicates(df: DataFrame, k: int = 5, threshold: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row: components of the texts whose k-word shingle sets have a
    Jaccard similarity of ``threshold`` percent or more."""
    given = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    own = ["n", "cls", "cls2"]
    base = stored(signatures(given, k).select("id", "sig.*"), "signatures")
    some = F.expr("n > 0 and id is not null")
    classes = stored(base.where(some).groupBy(*own).agg(F.min("id").alias("rep"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch")), "classes")
    found = forest(classes, threshold)
    dense = found.where("kind = 1")
    pairs = stored(found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("votes")), "pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(dense.select("a")).distinct()
    # a merge join at every size: what would be broadcast here grows with the documents
    texts = given.join(wanted.hint("merge"), "id")

    # rows by their class's least id; ids that have several rows
    rows = stored(base.where(some).select("id", *own).join(classes.select(*own, "rep"), own).select("id", "n", "rep"), "members")
    several = stored(rows.groupBy("id").agg(F.count("*").alias("c"), F.min("rep").alias("least"), F.max("rep").alias("most")).where("c > 1"), "several")
    repeated = several.limit(1).count() > 0
    texts = stored(texts.dropDuplicates(["id", "text"]) if repeated else texts, "texts")

    best = pairs.groupBy("b").agg(F.max(F.struct("votes", (-F.col("a")).alias("least"))).alias("best")).select((-F.col("best.least")).alias("a"), "b")
    # links are stored before they go on, so that no task holds two Python workers: the executor keeps as many as ever ran at once
    links = stored(_confirm(best, texts, k, threshold), "links")
    if repeated:
        links = links.union(rows.join(several.where("least <> most").select("id", "least"), "id").select("least", "rep"))
    first = components(links)
    label = lambda c: first.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    rest = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").select("a", "b", F.coalesce("label_a", "a").alias("la"), F.coalesce("label_b", "b").alias("lb")).where("la <> lb")
    rest = stored(_confirm(rest.join(best, ["a", "b"], "left_anti").select("a", "b"), texts, k, threshold), "links")
    sizes = classes.groupBy(F.col("rep").alias("id")).agg(F.sum("n").alias("n"))
    across = stored(across_components(dense, first, sizes, texts, k, threshold), "links")
    whole = components(first.union(rest).union(across), "node", "label")
    moved = whole.where("node <> label")
    member = rows.join(moved, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("label", "rep").alias("component"))
    alone = base.where(~some | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    return member.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op3_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"), k=2, threshold=80)
