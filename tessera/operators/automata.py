"""Ordered automata as a scan: what state a finite automaton is in at each of a document's blocks, for documents of any
length.

A block is a map from state to state, as an array of next states.  Maps compose associatively, so blocks are composed by
chunks of ``CHUNK``, chunks by chunks of chunks, and so on up to one map a document; then states are handed down, from
the start to the chunks and to their blocks.  No document has to fit a task: a chunk does.  What a fold would do in one
pass takes as many levels as the longest document has powers of ``CHUNK``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import checkpointed

CHUNK = 256


def transitions(states: int, moves: dict[str, list[int]], role: Column) -> Column:
    """The map of a block by its role; roles that aren't named leave every state as it is."""
    same = list(range(states))
    for to in moves.values():
        if len(to) != states or not all(0 <= s < states for s in to):
            raise ValueError("a move names a next state for each state")
    row = lambda to: F.array(*map(F.lit, to))
    out = row(same)
    for name, to in moves.items():
        out = F.when(role == name, row(to)).otherwise(out)
    return out


def _composed(maps: Column, states: int) -> Column:
    return F.aggregate(maps, F.array(*map(F.lit, range(states))), lambda a, m: F.transform(a, lambda s: F.get(m["map"], s)))


def _entered(maps: Column, state: Column) -> Column:
    """(at, state) of each map in order: the state that it is entered in."""
    start = F.struct(state.alias("state"), F.array().cast("array<struct<at: bigint, state: int>>").alias("out"))
    step = lambda a, m: F.struct(F.get(m["map"], a["state"]).alias("state"), F.array_append(a["out"], F.struct(m["at"].alias("at"), a["state"].alias("state"))).alias("out"))
    return F.aggregate(maps, start, step)["out"]


def scan(blocks: DataFrame, key: str, order: str, move: str, states: int, start: int = 0) -> DataFrame:
    """``blocks`` with ``before`` and ``after``: the states that each is entered and left in.

    ``order`` numbers a document's blocks from 0, each number once; gaps are allowed, and cost nothing but empty places.
    Defined results: rows of a null key or number are left out; an empty table gives an empty result.
    """
    rows = blocks.where(F.col(key).isNotNull() & F.col(order).isNotNull())
    longest = rows.agg(F.max(order)).first()[0]
    level = rows.select(F.col(key).alias("key"), F.col(order).cast("long").alias("at"), F.col(move).cast("array<int>").alias("map"))
    levels, most = [], (longest or 0) + 1
    while True:
        grouped = level.groupBy("key", F.floor(F.col("at") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("maps"))  # CHUNK at most
        levels.append(checkpointed(grouped))
        most = -(-most // CHUNK)
        if most <= 1:
            break
        level = levels[-1].select("key", F.col("chunk").alias("at"), _composed(F.col("maps"), states).alias("map"))
    entered = None
    for chunks in reversed(levels):
        into = chunks.withColumn("state", F.lit(start)) if entered is None else chunks.join(entered, ["key", "chunk"])
        entered = into.select("key", F.explode(_entered(F.col("maps"), F.col("state"))).alias("e")).select("key", F.col("e.at").alias("chunk"), F.col("e.state").alias("state"))
    found = entered.select(F.col("key").alias(key), F.col("chunk").cast(dict(rows.dtypes)[order]).alias(order), F.col("state").alias("before"))
    return rows.drop("before", "after").join(found, [key, order]).withColumn("after", F.get(move, F.col("before")))


# The flags of a document's front and back: bit 1 in the abstract, bit 2 in the references.
FLAGS = 4
FLAG_MOVES = {
    "abstract_heading": [1, 1, 3, 3],
    "keywords": [0, 0, 2, 2],
    "section": [0, 0, 0, 0],
    "references_heading": [2, 2, 2, 2],
}


def open_parts(blocks: DataFrame, key: str = "doc_id", order: str = "place", role: str = "role") -> DataFrame:
    """``blocks`` with ``abstract_open`` and ``references_open`` as they are when a block is reached, and ``part``: the role of
    plain blocks by them."""
    moved = blocks.withColumn("_move", transitions(FLAGS, FLAG_MOVES, F.col(role)))
    got = scan(moved, key, order, "_move", FLAGS)
    flag = lambda bit: F.col("before").bitwiseAND(F.lit(bit)) != 0
    plain = F.col(role) == "paragraph"
    part = F.when(plain & flag(2), "reference").when(plain & flag(1), "abstract").otherwise(F.col(role))
    return got.select(*blocks.columns, flag(1).alias("abstract_open"), flag(2).alias("references_open"), part.alias("part"))
