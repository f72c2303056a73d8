"""Edits of texts as rows: each replaces a span of code points, from ``start`` to before ``end``, by ``new``.

Edits that overlap are settled in the order of their places; those that stand move to their places in the new text by prefix
sums of what the ones before them add; a text is put together once from all of its edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.ship import ship

#: Fixed value: a marker of cited sources, such as ``[3]`` or ``[1, 4]``.
MARKER = r"\[(\d+(?:\s*[,;]\s*\d+)*)\]"


def settled(edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The edits that stand: from the left, each that begins at or after the end of the last one that stood.

    Of edits with one start, insertions come first, then longer spans, then lesser ids.  ``edits``: (key, id, start, end, new).
    Insertions at one place all stand, in the order of their ids; one within a span that is replaced doesn't.  A null ``new``
    is empty; edits with a null key or place, or that end before they start, or start before 0, don't stand.  A text's edits pass
    through one task in order, and none is held.
    """
    ship(edits.sparkSession)
    given = edits.where(f"`{key}` IS NOT NULL AND start >= 0 AND end >= start")
    given = given.select(F.col(key), F.col("id").cast("long"), F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce("new", F.lit("")).alias("new"))

    def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last = None, 0
        for pdf in batches:
            keep = []
            for k, start, end in zip(pdf[key].tolist(), pdf["start"].tolist(), pdf["end"].tolist()):
                if k != own:
                    own, last = k, 0
                keep.append(start >= last)
                if start >= last:
                    last = end
            yield pdf[keep]

    ordered = given.repartition(key).sortWithinPartitions(F.col(key), F.col("start"), F.col("end") > F.col("start"), F.desc("end"), F.col("id"))
    return ordered.mapInPandas(stand, given.schema)


def _rank() -> list[Column]:
    return [F.col("start"), F.col("end"), F.col("id")]


def placed(standing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Edits that stand with ``at``: where what they put begins in the new text."""
    added = F.sum(F.char_length("new") - (F.col("end") - F.col("start")))
    before = added.over(Window.partitionBy(key).orderBy(*_rank()).rowsBetween(Window.unboundedPreceding, -1))
    return standing.withColumn("at", F.col("start") + F.coalesce(before, F.lit(0)))


def _lists(standing: DataFrame, key: str) -> DataFrame:
    return standing.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*_rank(), "new"))).alias("_e"))


def _with_edits(texts: DataFrame, standing: DataFrame, key: str, text: str) -> DataFrame:
    joined = texts.join(_lists(standing, key), key, "left")
    return joined.withColumn("_c", F.when(F.col("_e").isNotNull(), F.split(F.coalesce(text, F.lit("")), "")))


def _cut(start: Column, end: Column) -> Column:
    return F.array_join(F.slice("_c", (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int")), "")


def applied(texts: DataFrame, standing: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``texts`` under their edits.  Places beyond a text's end are its end; a null text is empty once it is edited; a text
    without edits stays as it is.  A key that several rows share is edited in each."""
    rows = _with_edits(texts, standing, key, text)
    size = F.char_length(F.coalesce(text, F.lit("")))
    before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("_e", i - 1)["end"])
    pieces = F.transform("_e", lambda e, i: F.concat(_cut(before(i), e["start"]), e["new"]))
    tail = _cut(F.element_at("_e", -1)["end"], size.cast("long"))
    return rows.withColumn(text, F.when(F.col("_e").isNotNull(), F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))).select(*texts.columns)


def inverse(texts: DataFrame, standing: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The edits that make the old texts of the new ones; ``texts`` are the old ones, a row a key.  Edits beyond a text's end have
    no place to go back to: cut them to the text first."""
    moved = _with_edits(texts, placed(standing, key).withColumn("new", F.struct("new", "at")), key, text)
    back = F.transform("_e", lambda e: F.struct(e["id"].alias("id"), e["new"]["at"].alias("start"), (e["new"]["at"] + F.char_length(e["new"]["new"])).alias("end"), _cut(e["start"], e["end"]).alias("new")))
    return moved.where("_e IS NOT NULL").select(key, F.explode(back).alias("b")).select(key, "b.*")


def _numbers(s: Column) -> Column:
    """The numbers of all markers of a text."""
    inside = F.regexp_extract_all(s, F.lit(MARKER), F.lit(1))
    return F.flatten(F.transform(inside, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("int"))))


def citations(texts: DataFrame, selected: DataFrame, heading: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Edits (key, id, start, end, new) that write sources into texts: a marker at each place, and a list at the end.

    ``selected``: (key, place, source, title), the source by its id.  A text's sources are numbered as they are first seen, from
    the greatest number of the text's own markers on.  One place gets one marker of its sorted numbers; where the text has a
    marker there, after spaces or not, and no other place within it, the numbers join it.  The list's lines go by number under ``heading``, with each source's
    least title.  Ids count a text's edits by place.  Places outside of the text, and rows without place or source, are left out.
    """
    t = texts.where(F.col(key).isNotNull()).select(key, F.coalesce(text, F.lit("")).alias("_t"), F.char_length(F.coalesce(text, F.lit(""))).cast("long").alias("_n"))
    s = selected.where("place IS NOT NULL AND source IS NOT NULL AND place >= 0").select(key, F.col("place").cast("long").alias("place"), "source", "title")
    inside = s.join(t.select(key, "_n"), key).where("place <= _n")
    first = inside.groupBy(key, "source").agg(F.min("place").alias("_p"), F.min("title").alias("title"))
    own = t.select(key, F.coalesce(F.array_max(_numbers(F.col("_t"))), F.lit(0)).alias("_m"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_p", "source"))
    number = first.join(own, key).select(key, "source", "title", (F.col("_m") + rank).cast("int").alias("number"))
    marks = inside.join(number.select(key, "source", "number"), [key, "source"]).groupBy(key, "place").agg(F.array_sort(F.collect_set("number")).alias("_k"))
    # a text's places look into one copy of it
    by_text = marks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "_k"))).alias("_p")).join(t, key).withColumn("_c", F.split("_t", ""))
    # what lies between a place and the next one
    to = lambda i: F.coalesce(F.get("_p", i + 1)["place"], F.col("_n"))
    here = lambda p, i: F.regexp_extract(_cut(p["place"], to(i)), rf"^[ \t]*{MARKER}", 0)
    there = F.transform("_p", lambda p, i: F.struct(p["place"].alias("place"), p["_k"].alias("_k"), here(p, i).alias("has")))
    e = by_text.select(key, F.explode(there).alias("e")).select(key, "e.*")
    merged = F.array_sort(F.array_union(F.col("_k"), _numbers(F.col("has"))))
    lead = F.when(F.col("has") == "", F.lit(" ")).otherwise(F.regexp_extract("has", r"^[ \t]*", 0))
    shown = F.concat(lead, F.lit("["), F.array_join(F.transform(merged, lambda n: n.cast("string")), ", "), F.lit("]"))
    markers = e.select(key, F.col("place").alias("start"), (F.col("place") + F.char_length("has")).alias("end"), shown.alias("new"), F.lit(0).alias("_o"))
    lines = number.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("number", "title"))).alias("_l"))
    listed = F.array_join(F.transform("_l", lambda x: F.concat(F.lit("\n["), x["number"].cast("string"), F.lit("] "), F.coalesce(x["title"], F.lit("")))), "")
    tail = lines.join(t.select(key, "_n"), key).select(key, F.col("_n").alias("start"), F.col("_n").alias("end"), F.concat(F.lit("\n" + heading), listed).alias("new"), F.lit(1).alias("_o"))
    both = markers.unionByName(tail)
    return both.select(key, F.row_number().over(Window.partitionBy(key).orderBy("start", "_o")).cast("long").alias("id"), "start", "end", "new")
