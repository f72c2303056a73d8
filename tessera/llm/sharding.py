"""Sharding by fixed virtual slots.

Records hash into ``SLOTS`` slots, once and for all.  Bytes are summed per slot, and a small versioned
table maps every slot, empty ones too, to a shard: version 1 gives the heaviest slots out first, each to the lightest
shard.  Where a map is stored already, ``assign_shards`` reads its highest version, edits it by ``rebalance``, which
moves as few bytes as it can, and stores the edited one as the next version; a map that needs no edit stays as it is.
A record's shard is then one lookup in a table of ``SLOTS`` rows, whatever the number of records, and only the
records of moved slots ever change their shard.

The law that holds is ``bytes``: the shards' sizes are near equal.  So equal texts (of different keys) are spread as
any records are; the law keeps no group together.  The driver sees the map and the slot totals alone, ``SLOTS`` rows
at most.

Defined results: a null text has no bytes (size 8) and crc32 0; texts of any length are read whole, and one that
outweighs a shard's share makes its shard heavier; null ids hash like any value; records equal in every column are
counted, not gathered, and are spread over slots by their number, so a record repeated a million times doesn't make
one slot heavy; of slots of equal weight the lower is given out first, of equal shards the lower takes it; other
columns, whatever their names, aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import atexit
import heapq
import uuid
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _remove, cut, shared_dir

SLOTS = 8192
ROW_BYTES = 8


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """One row a record: key, size, text_crc32 and its virtual slot."""
    t = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    return (
        df.select(F.col(key), (F.octet_length(t).cast("long") + ROW_BYTES).alias("size"), F.crc32(t).alias("text_crc32"))
        .groupBy(key, "size", "text_crc32")
        .agg(F.count("*").alias("_n"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .withColumn("vslot", F.pmod(F.xxhash64(key, "size", "text_crc32", "_copy"), F.lit(slots)).cast("int"))
        .drop("_n")
    )


def _give(slots: list[tuple[int, int]], load: dict[int, int], mapping: dict[int, int]) -> dict[int, int]:
    """``mapping`` with ``slots`` (slot, weight), heaviest first, each on the shard that is lightest then; empty ones go
    to the shard with the fewest slots."""
    for some in (lambda w: w > 0, lambda w: w == 0):
        counts = Counter(mapping.values())
        heap = [(n if some(1) else counts[s], s) for s, n in load.items()]
        heapq.heapify(heap)
        for slot, w in sorted(filter(lambda x: some(x[1]), slots), key=lambda x: (-x[1], x[0])):
            total, shard = heapq.heappop(heap)
            mapping[slot] = shard
            heapq.heappush(heap, (total + (w or 1), shard))
    return mapping


def heaviest(mapping: dict[int, int], weights: dict[int, int]) -> int:
    load = Counter()
    for slot, shard in mapping.items():
        load[shard] += weights.get(slot, 0)
    return max(load.values(), default=0)


def plan(weights: dict[int, int], shards: int) -> dict[int, int]:
    """Slot to shard, anew."""
    return _give(list(weights.items()), dict.fromkeys(range(shards), 0), {})


def rebalance(old: dict[int, int], weights: dict[int, int], shards: int, slack: float = 0.001) -> dict[int, int]:
    """``old`` edited for new weights or a new number of shards: slots leave a shard only while it is more than ``slack``
    above the mean (or is no longer there), and go to the lightest one.  Where that makes the heaviest shard no lighter,
    nothing is moved."""
    new, load = {}, dict.fromkeys(range(shards), 0)
    homeless, most = [], (1 + slack) * sum(weights.values()) / shards
    for slot, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
        shard = old.get(slot)
        if shard in load and (load[shard] + w <= most or not w):
            new[slot], load[shard] = shard, load[shard] + w
        else:
            homeless.append((slot, w))
    new = _give(homeless, load, new)
    whole = all(old.get(s) in load for s in weights)
    return {s: old[s] for s in weights} if whole and heaviest(old, weights) <= heaviest(new, weights) else new


def slot_weights(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot: SLOTS rows at most."""
    return records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def versions(spark, path: str) -> list[int]:
    """The versions of the map at ``path``, ascending; versions are partitions of one table."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in names if n.startswith("version=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def read_map(spark, path: str, version: int) -> dict[int, int]:
    return {r["vslot"]: r["shard"] for r in spark.read.parquet(f"{path}/version={version}").collect()}  # SLOTS rows


def write_map(spark, path: str, version: int, mapping: dict[int, int]) -> None:
    """Store a version of the map; earlier ones stay readable, and one that was completed is never overwritten."""
    if version in versions(spark, path):
        raise ValueError(f"version {version} of {path} exists")
    spark.createDataFrame(sorted(mapping.items()), "vslot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def assign_shards(records: DataFrame, shards: int, map_path: str | None = None, key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``digests`` rows with ``shard``, ``slot``, the record's place in its shard, without gaps, and ``map_version``.

    ``map_path`` names the stored map; without it there is none yet, and this session's is removed at its end.
    Places are numbered within virtual slots, each a small window, and moved up by the rows of the slots
    before; no window spans a shard.
    """
    spark = records.sparkSession
    records = cut(records)
    totals = {r["vslot"]: (r["bytes"], r["n"]) for r in slot_weights(records).collect()}
    weights = {s: totals.get(s, (0, 0))[0] for s in range(slots)}
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    if map_path is None:
        atexit.register(_remove, spark, path)
    have = versions(spark, path)
    old = read_map(spark, path, have[-1]) if have else None
    mapping = plan(weights, shards) if old is None else rebalance(old, weights, shards)
    version = have[-1] if mapping == old else (have[-1] if have else 0) + 1
    if mapping != old:
        write_map(spark, path, version, mapping)
    first, begin = {}, []
    for slot in sorted(totals):  # the place in its shard of each slot's first record
        begin.append((slot, first.get(mapping[slot], 0)))
        first[mapping[slot]] = first.get(mapping[slot], 0) + totals[slot][1]
    stored_map = spark.read.parquet(f"{path}/version={version}").join(spark.createDataFrame(begin, "vslot int, first long"), "vslot")
    within = Window.partitionBy("vslot").orderBy(key, "size", "text_crc32", "_copy")
    return (
        records.withColumn("_place", F.row_number().over(within) - 1)
        .join(F.broadcast(stored_map), "vslot")  # SLOTS rows at most
        .withColumn("slot", F.col("first") + F.col("_place"))
        .withColumn("map_version", F.lit(version))
        .drop("_place", "first")
    )


def op2_sharding(spark, sf_dir: str, map_path: str | None = None, shards: int = 24) -> DataFrame:
    from .common import table

    got = assign_shards(digests(table(spark, sf_dir, "documents").select("doc_id", "text")), shards, map_path)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", "map_version")
