"""Plan-versus-fact registry: matrices, roll-ups, shares, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, half to even, capped at 100; 0 where there is no whole."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, 0).otherwise(F.least(F.lit(100), F.bround(100.0 * part / whole, 0).cast("int")))


def plan_fact_matrix(plans: DataFrame, facts: DataFrame, owner: str, kind: str, quantity: str, plan_id: str, fact_plan: str) -> DataFrame:
    """(owner, kind, planned, matched, extra, state).

    A plan's facts count up to its quantity; what is over, or has no plan, is extra.  Facts are summed by plan before
    the join, so a popular plan is one row there.
    """
    done = facts.groupBy(F.col(fact_plan).alias(plan_id)).agg(F.count("*").alias("facts"))
    joined = plans.join(done, plan_id, "left").withColumn("facts", F.coalesce("facts", F.lit(0)))
    matched = F.least("facts", quantity)
    out = joined.groupBy(owner, kind).agg(
        F.sum(quantity).cast("long").alias("planned"), F.sum(matched).cast("long").alias("matched"), F.sum(F.greatest(F.lit(0), F.col("facts") - F.col(quantity))).cast("long").alias("extra")
    )
    state = F.when(F.col("matched") >= F.col("planned"), "done").when(F.col("matched") > 0, "partial").otherwise("open")
    return out.withColumn("state", state)


def rollups(facts: DataFrame, sets: list[list[str]], sums: dict[str, Column]) -> DataFrame:
    """Several roll-ups in one pass (grouping sets); a level's absent keys are null, and ``level`` is its number in ``sets``."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    out = facts.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_g"), *[v.alias(n) for n, v in sums.items()])
    number = F.lit(None).cast("int")
    for i, s in enumerate(sets):
        code = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        number = F.when(F.col("_g") == code, i).otherwise(number)
    return out.withColumn("level", number).drop("_g")


def with_share(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with ``share``, a row's part of its group's sum of ``value`` in percent."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return df.withColumn("share", F.when(total == 0, 0.0).otherwise(F.round(100.0 * F.col(value) / total, 4)))


def progress(counts: dict[str, DataFrame], key: str) -> DataFrame:
    """Counts by key from several tables in one row: the union of keys, zero where a table has none."""
    parts = None
    for name, df in counts.items():
        one = df.select(key, *[(F.lit(1) if n == name else F.lit(0)).alias(n) for n in counts])
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(*[F.sum(n).cast("long").alias(n) for n in counts])


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have one distinct value."""
    return df.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n")).where("_n = 1").drop("_n")


def academic_year(date: Column, first_month: int = 9) -> Column:
    """``2024/2025``: the year that begins in ``first_month``."""
    start = F.year(date) - F.when(F.month(date) < first_month, 1).otherwise(0)
    return F.concat(start.cast("string"), F.lit("/"), (start + 1).cast("string"))
