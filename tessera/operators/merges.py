"""Merging entities: which row each one is now, what refers to it, and the versions of both in a store that can go back.

Entities: (id, name, aliases, active, merged_into, last_used); references: (ref, entity, kind, version).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.shared import checkpointed

from .planning import canonical
from .stored import Stored


def united(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): where each entity ends under its own pointer and the wished merges (source, target).

    A merge is between what both sides are by now: the source's last row goes into the target's.  Where one source has several
    targets they become one entity too, the least first; a circle's root is its least member.  Pairs of an unknown id are
    left out.  Each round follows at least one wish for every source that has one, so there are as many as a source has
    targets at most, and mostly one.
    """
    roots = checkpointed(canonical(entities).withColumnRenamed("target", "root"))
    wishes = pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    while True:
        a, b = roots.select(F.col("id").alias("source"), F.col("root").alias("s")), roots.select(F.col("id").alias("target"), F.col("root").alias("t"))
        open_ = checkpointed(wishes.join(a, "source").join(b, "target").where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct())
        if open_.limit(1).count() == 0:
            return roots
        pointers = open_.groupBy(F.col("source").alias("id")).agg(F.min("target").alias("merged_into"))
        now = roots.select(F.col("root").alias("id")).distinct().join(pointers, "id", "left")
        step = canonical(now).select(F.col("id").alias("root"), "target")
        roots, wishes = checkpointed(roots.join(step, "root").select("id", F.col("target").alias("root"))), open_


def merged(entities: DataFrame, references: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the merges.  A dissolved entity is inactive and points at its root, which takes its name, aliases
    (after its own, each once, by the dissolved rows' ids) and later time of use.  References go to the root and keep their
    versions where they were there before; those that come get the next ones of their kind, by old entity, version and id.  A
    reference to an entity that isn't there stays.  Merges that are asked for again change nothing."""
    roots = united(entities, pairs)
    now = entities.join(roots, "id")
    gone = now.where("id <> root").withColumn("_a", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    taken = gone.groupBy(F.col("root").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "_a"))), lambda x: x["_a"])).alias("_more"), F.max("last_used").alias("_u"))
    rows = now.join(taken, "id", "left")
    both = F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.col("_more"))
    tidy = F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "") & ~x.eqNullSafe(F.col("name"))))
    entities_ = rows.select(
        "id",
        "name",
        F.when(F.col("_more").isNotNull() & (F.col("id") == F.col("root")), tidy).otherwise(F.col("aliases")).alias("aliases"),
        F.when(F.col("id") == F.col("root"), F.col("active")).otherwise(F.lit(False)).alias("active"),
        F.when(F.col("id") != F.col("root"), F.col("root")).alias("merged_into"),
        F.greatest("last_used", "_u").alias("last_used"),
    )
    r = references.join(roots.withColumnsRenamed({"id": "entity"}), "entity", "left").withColumn("root", F.coalesce("root", "entity"))
    stay, come = r.where("entity <=> root"), r.where("NOT entity <=> root")
    last = stay.groupBy("root", "kind").agg(F.max("version").alias("_m"))
    # places: those of the old entities before it, then its own; so a root's references don't have to meet in one task
    sizes = come.groupBy("root", "kind", "entity").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy("root", "kind").orderBy("entity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = before.join(last.select("root", F.col("kind").alias("_k"), "_m"), (before["root"] == last["root"]) & before["kind"].eqNullSafe(F.col("_k")), "left").select("entity", F.col("kind").alias("_k"), (F.coalesce("_m", F.lit(0)) + F.col("_b")).alias("_s"))
    own = F.row_number().over(Window.partitionBy("entity", "kind").orderBy("version", "ref"))
    moved = come.withColumn("_r", own).alias("c").join(start.alias("s"), (F.col("c.entity") == F.col("s.entity")) & F.col("c.kind").eqNullSafe(F.col("s._k")))
    moved = moved.select("ref", F.col("root").alias("entity"), "kind", (F.col("_s") + F.col("_r")).cast("long").alias("version"))
    return entities_, stay.select("ref", "entity", "kind", F.col("version").cast("long")).unionByName(moved)


def numbered(rows: DataFrame, order: str, start: int) -> DataFrame:
    """``rows`` with ``number``, gapless from ``start`` by a column: places within ranges, and the ranges' sizes before them."""
    ranged = checkpointed(rows.repartitionByRange(order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return ranged.withColumn("_r", place).join(F.broadcast(before), "_p").withColumn("number", F.lit(start - 1) + F.col("_b") + F.col("_r")).drop("_p", "_r", "_b")


def resolved(entities: DataFrame, names: DataFrame, name: str = "name", at: str = "at") -> tuple[DataFrame, DataFrame]:
    """Names (name, at) to entities by normalised name, following merges: (name, id, created), a row a name, and the entities
    after it: those found are active and used at the latest time, and names that nobody has are new ones, after the greatest id,
    in the order of their normalised names, spelt as the least of their forms.  Null and empty names get null.  A normalised
    name that several entities have is the one of least id."""
    asked = names.groupBy(F.col(name).alias("_raw")).agg(F.max(at).alias("_at")).withColumn("_k", X.normalise(F.col("_raw")))
    keys = asked.where("_k <> ''").groupBy("_k").agg(F.min("_raw").alias("_raw"), F.max("_at").alias("_at"))
    known = entities.groupBy(X.normalise(F.col("name")).alias("_k")).agg(F.min("id").alias("id")).join(canonical(entities), "id").select("_k", F.col("target").alias("id"))
    hits = keys.join(known, "_k")
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = checkpointed(numbered(keys.join(known, "_k", "left_anti"), "_k", top + 1).withColumn("id", F.col("number").cast("long")))
    used = hits.groupBy("id").agg(F.max("_at").alias("_at"))
    old = entities.join(used, "id", "left").select("id", "name", "aliases", (F.col("active") | F.col("_at").isNotNull()).alias("active"), "merged_into", F.greatest("last_used", "_at").alias("last_used"))
    fresh = new.select("id", F.col("_raw").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(True).alias("active"), F.lit(None).cast("long").alias("merged_into"), F.col("_at").alias("last_used"))
    found = hits.select("_k", "id", F.lit(False).alias("created")).unionByName(new.select("_k", "id", F.lit(True).alias("created")))
    answer = asked.join(found, "_k", "left").select(F.col("_raw").alias(name), "id", F.coalesce("created", F.lit(False)).alias("created"))
    return answer, old.unionByName(fresh)


class Register(Stored):
    """Entities and references in a folder, one version a change: both tables of a version become visible at once, of two
    writers the second works on the first one's version, and an earlier version can be made the latest again."""

    def tables(self, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        manifest = self.manifest if version is None else json.loads(self.folder.read(f"manifests/{version:09d}.json"))
        at = f"{self.path}/segments/{manifest['segments'][-1]['name']}"
        return self.spark.read.parquet(f"{at}/entities"), self.spark.read.parquet(f"{at}/references")

    def change(self, made: Callable[[DataFrame | None, DataFrame | None], tuple[DataFrame, DataFrame]]) -> int:
        """The version that ``made`` makes of the latest one's tables (None for the first)."""
        while True:
            self.version, self.manifest = self._latest()
            base = self.version
            entities, references = made(*(self.tables() if base else (None, None)))
            name = uuid.uuid4().hex
            entities.write.parquet(f"{self.path}/segments/{name}/entities")
            references.write.parquet(f"{self.path}/segments/{name}/references")
            if self._claim(base, name):
                return self.version
            self.folder.remove(f"segments/{name}")

    def merge(self, pairs: DataFrame) -> int:
        return self.change(lambda e, r: merged(e, r, pairs))

    def undo(self, version: int) -> int:
        """Makes the tables of an earlier version the latest."""
        name = json.loads(self.folder.read(f"manifests/{version:09d}.json"))["segments"][-1]["name"]
        while not self._claim(self.version, name):
            self.version, self.manifest = self._latest()
        return self.version

    def _claim(self, base: int, name: str) -> bool:
        manifest = {"segments": [{"name": name}]}
        if not self.folder.claim(f"manifests/{base + 1:09d}.json", json.dumps(manifest)):
            return False
        self.version, self.manifest = base + 1, manifest
        return True
