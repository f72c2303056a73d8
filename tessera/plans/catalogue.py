"""Catalogue queries: search, cascades, computed columns, classifiers, identity keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import workflow as W

from .query import Tables, query


def contains_any(needle: str, *columns: str):
    """Case-insensitive containment in any of several columns."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in columns])


@query("contains_search", "SELECT DISTINCT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(c_name), '12') OR contains(lower(n_name), '12') OR contains(lower(r_name), '12') OR contains(lower(c_mktsegment), '12')")
def contains_search(t: Tables) -> DataFrame:
    """One needle over four fields of three tables; each person once."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.where(contains_any("12", "c_name", "n_name", "r_name", "c_mktsegment")).select("c_custkey", "c_name", "n_name").distinct()


@query(
    "resolution_cascade",
    """
WITH q(q) AS (VALUES ('5'), ('Brand#13'), ('zzz'), ('12')),
h AS (SELECT q, p_partkey, 1 AS step FROM q JOIN part ON p_partkey::VARCHAR = q UNION ALL SELECT q, p_partkey, 2 FROM q JOIN part ON lower(p_name) = lower(q) UNION ALL SELECT q, min(p_partkey), 3 FROM q JOIN part ON contains(lower(p_brand), lower(q)) GROUP BY q HAVING count(*) = 1)
SELECT q, coalesce(arg_min(p_partkey, (step, p_partkey)), -1) AS p_partkey, coalesce(min(step), 0) AS step FROM q LEFT JOIN h USING (q) GROUP BY q
""",
)
def resolution_cascade(t: Tables) -> DataFrame:
    """Exact key, else exact name, else the only one that contains the query."""
    q = F.broadcast(t.spark.sql("SELECT * FROM VALUES ('5'), ('Brand#13'), ('zzz'), ('12') AS q(q)"))  # four rows
    p = t.part.select("p_partkey", "p_name", "p_brand")
    by_key = p.join(q, F.col("p_partkey").cast("string") == F.col("q")).select("q", "p_partkey", F.lit(1).alias("step"))
    by_name = p.join(q, F.lower("p_name") == F.lower("q")).select("q", "p_partkey", F.lit(2).alias("step"))
    held = p.join(q, F.contains(F.lower("p_brand"), F.lower("q"))).groupBy("q").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).where("n = 1").select("q", "p_partkey", F.lit(3).alias("step"))
    hits = by_key.unionByName(by_name).unionByName(held).groupBy("q").agg(F.min_by("p_partkey", F.struct("step", "p_partkey")).alias("p_partkey"), F.min("step").alias("step"))
    return q.join(hits, "q", "left").select("q", F.coalesce("p_partkey", F.lit(-1)).alias("p_partkey"), F.coalesce("step", F.lit(0)).alias("step"))


@query(
    "computed_flags",
    "SELECT o_orderkey, o_orderstatus = 'O' AND o_totalprice < 100000 AS can_delete, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'finished' ELSE 'in part' END AS label FROM orders",
)
def computed_flags(t: Tables) -> DataFrame:
    """A flag and a label for each state."""
    label = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "finished").otherwise("in part")
    return t.orders.select("o_orderkey", ((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") < 100000)).alias("can_delete"), label.alias("label"))


# Ordered rules (label, pattern), the first that fits decides.
_RULES = (("coating", "PLATED|BURNISHED"), ("polish", "POLISHED|BRUSHED"), ("size", "LARGE|SMALL"), ("line", "PROMO|STANDARD|ECONOMY"))


@query(
    "ordered_classifier",
    "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(upper(p_type), '{p}') THEN '{label}'" for label, p in _RULES) + " ELSE 'other' END AS class, "
    "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(upper(p_type), '{p}') THEN '{label}' END" for label, p in _RULES) + "], lambda x: x IS NOT NULL) AS labels FROM part",
)
def ordered_classifier(t: Tables) -> DataFrame:
    """The first rule that fits, and all that do."""
    kind = F.upper("p_type")
    first = F.lit("other")
    for label, pattern in reversed(_RULES):
        first = F.when(kind.rlike(pattern), label).otherwise(first)
    every = F.array_compact(F.array(*[F.when(kind.rlike(p), label) for label, p in _RULES]))
    return t.part.select("p_partkey", first.alias("class"), every.alias("labels"))


@query(
    "level_order",
    "SELECT p_brand, row_number() OVER (ORDER BY CASE WHEN p_brand LIKE '%3' THEN 0 WHEN p_brand LIKE '%1' THEN 1 ELSE 2 END, coalesce(try_cast(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER), 999), p_brand)::INTEGER AS place FROM (SELECT DISTINCT p_brand FROM part)",
)
def level_order(t: Tables) -> DataFrame:
    """Preferred levels first, then by number."""
    from pyspark.sql import Window

    group = F.when(F.col("p_brand").like("%3"), 0).when(F.col("p_brand").like("%1"), 1).otherwise(2)
    number = F.coalesce(F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int"), F.lit(999))
    return t.part.select("p_brand").distinct().withColumn("place", F.row_number().over(Window.orderBy(group, number, "p_brand")))  # a brand a row


@query("identity_keys", "SELECT o_orderkey, sha256('plan|' || o_custkey::VARCHAR || '|' || lower(trim(o_orderpriority)) || '|' || o_orderstatus) AS key FROM orders")
def identity_keys(t: Tables) -> DataFrame:
    """Composite identity digests."""
    return t.orders.select("o_orderkey", F.sha2(F.concat_ws("|", F.lit("plan"), F.col("o_custkey").cast("string"), F.lower(F.trim("o_orderpriority")), "o_orderstatus"), 256).alias("key"))


@query("tolerance_check", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) > 0.02 + 1e-9 AS off_discount, abs(l_tax - 0.04) > 0.03 + 1e-9 AS off_tax FROM lineitem")
def tolerance_check(t: Tables) -> DataFrame:
    """Values against rules with tolerances."""
    off = lambda c, want, within: (F.abs(F.col(c) - want) > within + 1e-9)
    return t.lineitem.select("l_orderkey", "l_linenumber", off("l_discount", 0.05, 0.02).alias("off_discount"), off("l_tax", 0.04, 0.03).alias("off_tax"))


@query("next_version", "SELECT l_orderkey, max(l_linenumber) + 1 AS next_version, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS last_flag FROM lineitem GROUP BY l_orderkey")
def next_version(t: Tables) -> DataFrame:
    """The next version's number, and the last one's flag."""
    return t.lineitem.groupBy("l_orderkey").agg((F.max("l_linenumber") + 1).alias("next_version"), F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("last_flag"))


@query("decision_history", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def decision_history(t: Tables) -> DataFrame:
    """Subjects with a decision of one kind: a semi-join, so none is repeated."""
    decided = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(decided, "o_orderkey", "left_semi").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("latest_template", "SELECT p_type, p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_size DESC, p_partkey DESC) AS k FROM part) WHERE k = 1")
def latest_template(t: Tables) -> DataFrame:
    """The latest version for each target."""
    return W.latest(t.part, ["p_type", "p_brand"], [F.desc("p_size"), F.desc("p_partkey")]).select("p_type", "p_brand", "p_partkey", "p_size")
