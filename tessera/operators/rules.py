"""Template rules against documents: aliases, modal metrics, tolerances, required parts, file checks, digests, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def alias_roles(labels: DataFrame, aliases: DataFrame, key: str, label: str = "label") -> DataFrame:
    """(key, role, alias): each label's role by its longest alias (alias, role) that it begins with; word by word.

    Every leading run of a label's words is looked up, so the join is an equality.
    """
    words = F.split(X.normalise(F.col(label), keep_punctuation=False), " ")
    heads = labels.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("alias"))
    found = heads.join(aliases, "alias").groupBy(key).agg(F.max_by(F.struct("role", "alias"), F.length("alias")).alias("b"))
    return labels.select(key).join(found, key, "left").select(key, "b.role", "b.alias")


def modal(rows: DataFrame, by: list[str], place: str, columns: list[str], weight: Column | None = None) -> DataFrame:
    """(by..., columns...): each column's most frequent value in a group (by weight), of equal ones the first seen, then the least; nulls
    don't count.  All columns are counted in one pass over the rows."""
    one = F.lit(1) if weight is None else weight
    entries = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    counts = rows.select(*by, place, one.alias("_w"), F.explode(entries).alias("e")).where("e.v is not null").groupBy(*by, "e.c", "e.v").agg(F.sum("_w").alias("n"), F.min(place).alias("first"))
    best = counts.groupBy(*by, "c").agg(F.min_by("v", F.struct(-F.col("n"), "first", "v")).alias("v"))
    return best.groupBy(*by).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns])


def rule_issues(metrics: DataFrame, rules: DataFrame, key: str, group: str, tolerances: dict[str, float]) -> DataFrame:
    """(key, metric, expected, actual): one row for each metric that differs from its group's rule by more than its
    tolerance; a rule that is null asks for nothing, a metric that is null fails."""
    both = metrics.join(rules.select(group, *[F.col(m).alias(f"want_{m}") for m in tolerances]), group)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"want_{m}").cast("double").alias("expected"), F.col(m).cast("double").alias("actual"), F.lit(float(x)).alias("tolerance")) for m, x in tolerances.items()]
    wrong = lambda r: r["expected"].isNotNull() & (r["actual"].isNull() | (F.abs(r["actual"] - r["expected"]) > r["tolerance"]))
    return both.select(key, F.explode(F.filter(F.array(*rows), wrong)).alias("i")).select(key, "i.metric", "i.expected", "i.actual")


def required_parts(found: DataFrame, catalogue: DataFrame, key: str, role: str = "role") -> DataFrame:
    """(key, role, required, present): every subject against a small catalogue (role, required)."""
    subjects = found.select(key).distinct()
    have = found.select(key, role).distinct().withColumn("present", F.lit(True))
    return subjects.crossJoin(catalogue).join(have, [key, role], "left").withColumn("present", F.coalesce("present", F.lit(False)))  # a catalogue: few rows


def file_issues(files: DataFrame, checks: list[tuple[str, Column]], key: str) -> DataFrame:
    """(key, code, place): the checks that a file fails, in the order of the checks."""
    rows = F.filter(F.array(*[F.when(bad, F.struct(F.lit(code).alias("code"), F.lit(i).alias("place"))) for i, (code, bad) in enumerate(checks)]), lambda x: x.isNotNull())
    return files.select(key, F.explode(rows).alias("i")).select(key, "i.*")


def disagreement(a: Column, b: Column) -> Column:
    """Counts of two forms differ by more than one and a tenth."""
    return F.abs(a - b) > F.greatest(F.lit(1.0), 0.1 * a)


def log_facts(s: Column, number: str, patterns: dict[str, str]) -> list[Column]:
    """The greatest number that a pattern captures (0: none), and how often each of the others occurs."""
    values = F.transform(F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(number), F.lit(1)), lambda v: v.try_cast("double"))
    return [F.coalesce(F.array_max(values), F.lit(0.0)).alias("worst"), *[X.count_of(s, p).alias(n) for n, p in patterns.items()]]


def digests_hold(stored: DataFrame, actual: DataFrame, key: str, part: str, digest: str, closed: str) -> DataFrame:
    """(key, n, wrong, missing, valid): a package is valid when it is closed and each stored digest is the actual one."""
    both = stored.join(actual.select(key, part, F.col(digest).alias("_d")), [key, part], "left")
    same = F.col("_d").eqNullSafe(F.col(digest))
    return both.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("_d").isNotNull() & ~same).alias("wrong"), F.count_if(F.col("_d").isNull()).alias("missing"), F.bool_and(same & F.col(closed)).alias("valid"))


def histogram_peaks(values: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """(by..., bucket, n): buckets of ``width`` that hold more than their neighbours on either side (at least as many as the
    one after)."""
    counts = values.groupBy(*by, F.floor(F.col(value) / width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy("bucket")
    beside = lambda f, step: F.when(f("bucket").over(order) == F.col("bucket") + step, f("n").over(order)).otherwise(0)
    return counts.withColumns({"_a": beside(F.lag, -1), "_b": beside(F.lead, 1)}).where((F.col("n") > F.coalesce("_a", F.lit(0))) & (F.col("n") >= F.coalesce("_b", F.lit(0)))).drop("_a", "_b")


def clamped_median(rows: DataFrame, by: list[str], value: str, low: float, high: float, digits: int = 2) -> DataFrame:
    """(by..., median): each group's median, held between two bounds."""
    return rows.groupBy(*by).agg(F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.median(value))), digits).alias("median"))
