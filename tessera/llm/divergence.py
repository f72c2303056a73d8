"""Source divergence audit: how far each source's use of terms is from every other source's of its language.

Terms are counted by (language, source, term), with map-side sums, and a language keeps the terms of at least
``MIN_DOCS`` of its documents.  A group's p of a term is ``1 + SCALE * (count + 1) div (N + V)``; all arithmetic is on
integers.

Systolic rotation.  The groups of a language are numbered and cut into blocks, its terms into chunks; a *piece* is
one block's counts in one chunk, as compressed arrays.  Pieces stay where they are: the resident side is partitioned
by (language, block, lane) once, a lane being a fixed share of the chunks, and kept for all rounds.  In each round of
a round-robin tournament of the blocks (the circle method) every block meets one other: the piece of the
higher number is sent to where the lower one's lies, and both directions of all pairs of their groups are
evaluated there.  Before the rounds, each block meets itself.  A round is one job whose sums are written to the
shared folder, so a lost executor costs a part of one round.  A lane adds up its chunks before it hands on a pair's
sum.  A pair costs its two groups' own terms, not the vocabulary: the terms that neither has are all alike, and are
counted in one product.  The size of what meets is bounded: a piece has at most ``PIECE`` counts, whatever the numbers
of groups and terms; at most ``BLOCKS`` blocks a language take part, so there are at most ``BLOCKS - 1`` rounds.

Terms of a group are ranked by a heap in each piece, and the heaps' ``TOP`` at most are ranked again.

Defined results: null text, language and source are empty strings; of repeated rows each counts; a text without terms
still makes its group; a group that no kept term occurs in has count 0 for each; a language that keeps no term has
pairs of value 0; a source that is alone in its language has no pairs; ties are ordered by the item's UTF-8 bytes;
texts are read whole; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..ship import ship
from .common import stored

#: What is no letter, of the first 128 characters; the scale of p.
NOT_TERM, SCALE = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", 1_000_000_000
MIN_DOCS, TOP = 3, 200
#: Groups in a block at least, blocks of a language at most, counts in a piece at most, lanes of a block, sums held by a task.
BLOCK, BLOCKS, PIECE, LANES, HELD = 8, 16, 1 << 17, 32, 1 << 22


def terms_of(text: Column) -> Column:
    """A text's terms in order, only A to Z lower-cased; an empty string may stand at either end."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.length(t) == F.octet_length(t)  # lower() then changes A to Z alone
    lower = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.split(lower, NOT_TERM)


def _share(count: str, total: str) -> Column:
    """p of a count, exactly: a quotient of 38-digit numbers."""
    return F.expr(f"CAST(1 + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) DIV CAST(greatest({total}, 1) AS DECIMAL(19, 0)) AS BIGINT)")


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """(lang, source, term, n, lang_n): kept terms with their occurrences in the group and in the language."""
    # of a term's places in a sorted text, the first stands for the document; no lambdas, which Spark interprets term by term
    sets = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.sort_array(terms_of(F.col(text))).alias("term"))
    rows = sets.select("lang", "source", F.explode(F.arrays_zip("term", F.concat(F.array(F.lit("")), "term").alias("before"))).alias("t")).where("t.term <> ''")
    counts = rows.groupBy("lang", "source", "t.term").agg(F.count("*").alias("n"), F.sum((F.col("t.term") != F.col("t.before")).cast("long")).alias("docs"))
    own = Window.partitionBy("lang", "term")
    return counts.withColumns({"lang_docs": F.sum("docs").over(own), "lang_n": F.sum("n").over(own), "once": F.min("source").over(own) == F.col("source")}).where(F.col("lang_docs") >= MIN_DOCS).drop("docs", "lang_docs")


def roster(docs: DataFrame, counts: DataFrame, lang: str, source: str) -> DataFrame:
    """Every group with its number in its language, block, slot, total, and p of a count of 0; the language's totals and numbers."""
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("once").cast("long")).alias("terms"))
    own = Window.partitionBy("lang")
    got = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total", "terms"])
    got = got.withColumns({"v": F.sum("terms").over(own), "lang_total": F.sum("total").over(own), "groups": F.count("*").over(own), "number": F.row_number().over(own.orderBy("source")) - 1})
    size = F.greatest(F.lit(BLOCK), F.ceil(F.col("groups") / BLOCKS)).cast("int")
    got = got.withColumn("size", size).withColumns({"blocks": F.ceil(F.col("groups") / F.col("size")).cast("int"), "chunks": F.greatest(F.lit(1), F.ceil(F.col("v") * F.col("size") / PIECE)).cast("int")})
    return got.withColumns({"block": F.floor(F.col("number") / F.col("size")).cast("int"), "slot": F.pmod("number", "size").cast("int"), "absent": _share("0", "total + v")})


# ---- pieces: a block's counts in a chunk ----


def _pack(slot: np.ndarray, pos: np.ndarray, p: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([slot, np.diff(pos, prepend=0), p]).astype("<i8").tobytes(), 1)


def _unpack(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slot, step, p = np.frombuffer(zlib.decompress(data), "<i8").reshape(3, -1) if data else np.zeros((3, 0), np.int64)
    return slot, np.cumsum(step), p


def _piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """A piece from its rows: counts by slot and place, and each group's greatest terms in it."""
    pdf = pdf.sort_values(["slot", "pos"])
    slot, pos, p, q = (pdf[c].to_numpy(np.int64) for c in ("slot", "pos", "p", "q"))
    value = (p - q) * (p - q) // q
    top = []
    for s in np.unique(slot).tolist():
        at = np.flatnonzero((slot == s) & (p > q))
        best = heapq.nlargest(TOP, zip(value[at].tolist(), (-at).tolist(), strict=True))  # places are in the order of the terms
        top += [{"slot": s, "term": pdf["term"].iloc[-i], "value": v} for v, i in best]
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "block": [pdf["block"].iloc[0]], "data": [_pack(slot, pos, p)], "top": [top]})


def pieces(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, block, chunk, lane, blocks, v, absent, data, top): every block in every chunk, with or without counts."""
    rows = counts.join(groups.select("lang", "source", "block", "slot", "chunks", "total", "v", "lang_total"), ["lang", "source"])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    rows = rows.select("lang", "chunk", "block", "slot", "term", (F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("pos"), _share("n", "total + v").alias("p"), _share("lang_n", "lang_total + v").alias("q"))
    made = rows.groupBy("lang", "chunk", "block").applyInPandas(_piece, "lang string, chunk int, block int, data binary, top array<struct<slot: int, term: string, value: long>>")
    blocks = groups.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("slot", "absent"))).alias("absent"), *[F.first(c).alias(c) for c in ("blocks", "chunks", "v")])  # of ``size`` groups
    every = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return every.join(made, ["lang", "chunk", "block"], "left").select("lang", "block", "chunk", F.pmod("chunk", F.lit(LANES)).alias("lane"), "blocks", "v", F.col("absent.absent").alias("absent"), "data", "top")


# ---- meetings ----


def _evaluate(x: tuple, y: tuple, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two pieces' groups, the sums of f over the chunk's terms that either group has, less ``f`` of an absent term, and
    ``zero`` times that: [g, h] with q of the second piece's h, and with q of the first piece's g."""
    (slot, pos, p, absent), (slot_y, pos_y, p_y, absent_y) = x, y
    on_y, on_x = np.zeros((len(absent), len(absent_y)), np.int64), np.zeros((len(absent), len(absent_y)), np.int64)
    width = 1 + max(pos.max(initial=-1), pos_y.max(initial=-1))
    starts = np.searchsorted(slot, np.arange(len(absent)))
    some = np.diff(np.append(starts, len(slot))) > 0

    def by_group(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(absent), np.int64)
        if len(values):
            sums[some] = np.add.reduceat(values, starts[some])
        return sums

    for h in range(len(absent_y)):
        a, b = np.searchsorted(slot_y, [h, h + 1])
        ph, has = np.full(width, absent_y[h]), np.zeros(width, bool)
        ph[pos_y[a:b]], has[pos_y[a:b]] = p_y[a:b], True
        both = has[pos]
        theirs, mine = ph[pos], absent[slot]
        d = (p - theirs) ** 2
        alone = (mine - theirs) ** 2  # as if only the other had the term
        d0 = (absent - absent_y[h]) ** 2
        other = (absent[:, None] - p_y[None, a:b]) ** 2
        union = by_group(np.ones(len(pos), np.int64)) + (b - a) - by_group(both.astype(np.int64))
        on_y[:, h] = by_group(d // theirs - np.where(both, alone // theirs, 0)) + (other // p_y[None, a:b]).sum(1) + d0 // absent_y[h] * (zero - union)
        on_x[:, h] = by_group(d // p - np.where(both, alone // mine, 0)) + (other // absent[:, None]).sum(1) + d0 // absent * (zero - union)
    return on_y, on_x


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of the meetings of a task's pieces, added up over chunks."""
    sums: dict[tuple, list[np.ndarray]] = {}
    held = 0

    def out() -> pd.DataFrame:
        parts = []
        for (lang, block, peer), both in sums.items():
            for flip, m in enumerate(both):
                g, h = (x.ravel() for x in np.indices(m.shape))
                a, b = (block, peer), (g, h)
                parts.append(pd.DataFrame({"lang": lang, "block": a[flip], "slot": b[flip], "peer_block": a[1 - flip], "peer_slot": b[1 - flip], "value": m.ravel()}))
        return pd.concat(parts)

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            x = (*_unpack(r.data), np.asarray(r.absent, np.int64))
            y = x if r.peer == r.block else (*_unpack(r.peer_data), np.asarray(r.peer_absent, np.int64))
            got = _evaluate(x, y, r.v if r.chunk == 0 else 0)  # the terms of neither, once
            got = got[:1] if r.peer == r.block else got
            old = sums.get(k := (r.lang, r.block, r.peer))
            sums[k] = [m + n for m, n in zip(old, got, strict=True)] if old else list(got)
            held += 0 if old else sum(m.size for m in got)
            if held > HELD:
                yield out()
                sums, held = {}, 0
    if sums:
        yield out()


MET = "lang string, block int, slot int, peer_block int, peer_slot int, value long"
RESIDENT = ("lang", "block", "lane")


def pair_sums(parts: DataFrame) -> DataFrame:
    """(lang, block, slot, peer_block, peer_slot, value): every ordered pair of a language's groups, by the rotation."""
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    residents = parts.drop("top").repartition(n, *RESIDENT).persist()
    rounds = [residents.select("*", F.col("block").alias("peer"), F.lit(None).cast("binary").alias("peer_data"), F.lit(None).cast("array<long>").alias("peer_absent"))]
    most = parts.agg(F.max("blocks")).first()[0] or 0
    even = F.col("blocks") + F.col("blocks") % 2  # with an odd number, one rests in each round
    for r in range(most + most % 2 - 1 if most > 1 else 0):
        # the circle method: of n players i meets r - i mod n - 1, and who would meet itself meets the last
        turn = F.pmod(F.lit(r) - F.col("block"), even - 1)
        facing = F.when(F.col("block") == even - 1, F.pmod(F.lit(r) * (even / 2).cast("int"), even - 1)).when(turn == F.col("block"), even - 1).otherwise(turn)
        guests = parts.where(F.lit(r) < even - 1).withColumn("host", facing).where("host < block").select("lang", F.col("host").alias("block"), "lane", "chunk", F.col("block").alias("peer"), F.col("data").alias("peer_data"), F.col("absent").alias("peer_absent"))
        rounds.append(residents.join(guests, [*RESIDENT, "chunk"]))
    keys = ("lang", "block", "slot", "peer_block", "peer_slot")
    done = []
    for k, meeting in enumerate(rounds):
        met = meeting.select("lang", "block", "chunk", "v", "absent", "data", "peer", "peer_data", "peer_absent").mapInPandas(_meet, MET)
        done.append(stored(met.groupBy(*keys).agg(F.sum("value").alias("value")), f"round{k}"))
    residents.unpersist()
    return reduce(DataFrame.unionByName, done)


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by divergence, and the group's own terms."""
    ship(docs.sparkSession)
    counts = stored(term_counts(docs, lang, source, text), "terms")
    groups = stored(roster(docs, counts, lang, source), "groups")
    parts = stored(pieces(counts, groups), "pieces")
    names = groups.select("lang", "block", "slot", "source")
    peers = names.select("lang", F.col("block").alias("peer_block"), F.col("slot").alias("peer_slot"), F.col("source").alias("item"))
    pairs = pair_sums(parts).join(names, ["lang", "block", "slot"]).join(peers, ["lang", "peer_block", "peer_slot"]).where("source <> item")
    tops = parts.select("lang", "block", F.explode("top").alias("t")).select("lang", "block", "t.slot", F.col("t.term").alias("item"), "t.value").join(names, ["lang", "block", "slot"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [
        pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank")),
        tops.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= TOP),
    ]
    return ranked[0].unionByName(ranked[1])


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))
