"""Filter interaction audit: what five filters take from each other, in every order that they can be applied in.

A filter's work in an order depends on the *set* of filters applied before it alone.  So the 600 steps of the 120
orders are paths over the 80 edges (already-applied subset, next filter) of the subsets' lattice: documents are counted
once for each edge, and the edges' counts are joined to the steps.

One scan marks each document with the filters that it fails.  Documents are first summed by part, marks and labels (a
mark class contributes to every edge what its documents do), so the edges see a few rows a part, however many
documents there are.  The duplicate filter needs the least id of each text in the table: a text is known by its SHA-256
digest, copies of one part and label are summed before they meet, and what meets for one digest is a row for each part
and label, never its documents.

Defined results: a null text is an empty one (no words: it fails A, and none of B, C and D), a null part an empty
string; a null id has no smaller one and is smaller than none, so it neither fails E nor makes others fail; repeated
rows of one id and text count as often as they occur and don't fail E by each other; of several labels for one id, any
quality 1 makes it good and any toxic 1 toxic; null labels are neither; texts are read whole; a part that loses
nothing has its zeros; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, words

#: Fixed value: the filters, in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, r"[#$%&*|]"
DUPLICATE = 1 << FILTERS.index("E")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_marks(text: Column) -> Column:
    """The bits of the filters A to D that ``text`` fails."""
    t = F.coalesce(text, F.lit(""))
    of_words = let(words(text), lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0) + F.when(100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w), 2).otherwise(0))
    return of_words + F.when(100 * F.regexp_count(t, F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.length(t), 4).otherwise(0) + F.when(t.rlike(SYMBOLS), 8).otherwise(0)


def mark_classes(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, marks, good, toxic, n): documents by the filters that they fail, and by their labels."""
    one = docs.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
        text_marks(F.col(text)).alias("marks"),
    )
    # rows without an id have no label; their digest spreads them
    spread = F.coalesce(F.col("id").cast("string"), F.hex("digest"))
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    rows = one.withColumn("spread", spread).join(known.withColumn("spread", F.col("id").cast("string")), ["spread", "id"], "left").fillna(False, ["good", "toxic"])
    rows = rows.groupBy("spread", "id", "part", "digest", "marks", "good", "toxic").agg(F.count("*").alias("n"))
    summed = rows.groupBy("digest", "part", "marks", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min("id").alias("least"),
        F.min_by("n", "id").alias("least_n"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    firsts = F.col("without_id") + F.when(F.col("least") == F.col("first"), F.col("least_n")).otherwise(0)
    split = F.array(F.struct(F.col("marks").alias("marks"), firsts.alias("n")), F.struct((F.col("marks") + DUPLICATE).alias("marks"), (F.col("n") - firsts).alias("n")))
    return summed.withColumn("first", first).select("part", "good", "toxic", F.explode(split).alias("c")).where("c.n > 0").groupBy("part", "c.marks", "good", "toxic").agg(F.sum("c.n").alias("n"))


def edge_counts(classes: DataFrame) -> DataFrame:
    """(part, applied, filter, then ``COUNTS`` and shapley): the 80 edges of every part."""
    width = len(FILTERS)
    edges = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(math.factorial(s.bit_count()) * math.factorial(width - 1 - s.bit_count())).alias("orders")) for f in range(width) for s in range(1 << width) if not s >> f & 1])
    on = classes.select("part", "marks", "good", "toxic", "n", F.explode(edges).alias("e")).select("*", "e.*")
    fails = F.col("marks").bitwiseAND(F.col("bit")) != 0
    before = F.col("marks").bitwiseAND(F.col("applied")) != 0
    number = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    counts = on.groupBy("part", "applied", "filter", "orders").agg(
        number(~fails & ~before).alias("kept"),
        number(fails & ~before).alias("removed"),
        number(fails & before).alias("redundant"),
        number(F.col("marks") == F.col("bit")).alias("unique_fails"),
        number(fails & ~before & F.col("good")).alias("good_lost"),
        number(fails & ~before & F.col("toxic")).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "filter")).cast("long")).drop("orders")


def lattice_steps(spark) -> DataFrame:
    """(filter_order, step, applied, filter): each order's path over the edges."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        applied = 0
        for step, f in enumerate(order, 1):
            rows.append(f"('{''.join(FILTERS[x] for x in order)}', {step}, {applied}, {f})")
            applied |= 1 << f
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(filter_order, step, applied, filter)")


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each part, order of the filters, and step."""
    edges = edge_counts(mark_classes(docs, labels, part, key, text))
    steps = F.broadcast(lattice_steps(docs.sparkSession))  # 600 rows
    return edges.join(steps, ["applied", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return filter_audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))
