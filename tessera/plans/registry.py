"""Plan-versus-fact queries: orders are plans, line items facts, customers owners, priorities kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import registry as R

from .query import Tables, query

#: A plan's quantity: one, two or three results, from its key.
_QUANTITY = "1 + (o_orderkey % 3)"
_MATCHED = f"""
done AS (SELECT l_orderkey, count(*) AS facts FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey),
plan AS (SELECT o.*, {_QUANTITY} AS quantity, coalesce(facts, 0) AS facts FROM orders o LEFT JOIN done ON l_orderkey = o_orderkey)"""


def _plans(t: Tables) -> DataFrame:
    return t.orders.withColumn("quantity", F.expr(_QUANTITY))


def _facts(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag <> 'R'")


@query(
    "plan_fact_matrix",
    f"""
WITH {_MATCHED},
m AS (SELECT o_custkey, o_orderpriority, sum(quantity)::BIGINT AS planned, sum(least(facts, quantity))::BIGINT AS matched, sum(greatest(0, facts - quantity))::BIGINT AS extra FROM plan GROUP BY ALL)
SELECT *, CASE WHEN matched >= planned THEN 'done' WHEN matched > 0 THEN 'partial' ELSE 'open' END AS state FROM m
""",
)
def plan_fact_matrix(t: Tables) -> DataFrame:
    """Planned, matched and extra results by owner and kind, with their state."""
    return R.plan_fact_matrix(_plans(t), _facts(t), "o_custkey", "o_orderpriority", "quantity", "o_orderkey", "l_orderkey")


@query(
    "plan_fact_pivot",
    """
SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS medium
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY o_custkey
""",
)
def plan_fact_pivot(t: Tables) -> DataFrame:
    """The matrix with kinds as columns; the kinds are given, so no pass looks for them."""
    kinds = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium"}
    wide = t.orders.where(F.col("o_orderpriority").isin(list(kinds))).groupBy("o_custkey").pivot("o_orderpriority", list(kinds)).count()
    return wide.select("o_custkey", *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(n) for k, n in kinds.items()])


@query(
    "plan_fact_stats",
    f"""
WITH {_MATCHED},
w AS (SELECT r_name, n_name, o_orderpriority AS kind, quantity, least(facts, quantity) AS hit FROM plan JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT r_name, n_name, kind, sum(quantity)::BIGINT AS planned, sum(hit)::BIGINT AS matched,
  CASE grouping_id(r_name, n_name, kind) WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 6 THEN 2 ELSE 3 END::INTEGER AS level
  FROM w GROUP BY GROUPING SETS ((r_name), (r_name, n_name), (kind), ()))
SELECT *, (planned - matched) AS remaining, least(100, round_even(100.0 * matched / planned, 0)::INTEGER) AS percent FROM g
""",
)
def plan_fact_stats(t: Tables) -> DataFrame:
    """Departments, employees' groups, kinds and the grand total in one pass."""
    done = _facts(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("facts"))
    rows = (
        _plans(t)
        .join(done, "o_orderkey", "left")
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", "n_name", F.col("o_orderpriority").alias("kind"), "quantity", F.least(F.coalesce("facts", F.lit(0)), "quantity").alias("hit"))
    )
    out = R.rollups(rows, [["r_name"], ["r_name", "n_name"], ["kind"], []], {"planned": F.sum("quantity").cast("long"), "matched": F.sum("hit").cast("long")})
    return out.select("*", (F.col("planned") - F.col("matched")).alias("remaining"), R.percent(F.col("matched"), F.col("planned")).alias("percent"))


@query(
    "plan_summary",
    f"""
WITH {_MATCHED},
s AS (SELECT o_orderpriority AS kind, sum(quantity)::BIGINT AS planned, sum(CASE WHEN o_orderstatus = 'F' THEN least(facts, quantity) ELSE 0 END)::BIGINT AS completed FROM plan GROUP BY kind)
SELECT *, round(100.0 * planned / sum(planned) OVER (), 4) AS share FROM s
""",
)
def plan_summary(t: Tables) -> DataFrame:
    """Planned and completed by kind, with the kind's share of all plans."""
    done = _facts(t).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("facts"))
    hit = F.when(F.col("o_orderstatus") == "F", F.least(F.coalesce("facts", F.lit(0)), "quantity")).otherwise(0)
    s = _plans(t).join(done, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.sum("quantity").cast("long").alias("planned"), F.sum(hit).cast("long").alias("completed"))
    return s.withColumn("share", F.round(100.0 * F.col("planned") / F.sum("planned").over(Window.partitionBy(F.lit(1))), 4))  # one row a kind


@query(
    "owner_distinct_counts",
    """
SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS sent, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS approved,
  count(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O') AS open_kinds, max(o_orderdate) AS latest
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY sent DESC, approved DESC, latest DESC NULLS LAST, c_name, c_custkey
""",
)
def owner_distinct_counts(t: Tables) -> DataFrame:
    """Filtered distinct counts of every owner, in five-key order."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    when = lambda s, c: F.count_distinct(F.when(F.col("o_orderstatus") == s, F.col(c)))
    got = orders.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("sent"), when("F", "o_orderkey").alias("approved"), when("O", "o_orderpriority").alias("open_kinds"), F.max("o_orderdate").alias("latest"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = t.customer.join(got, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", zero("sent"), zero("approved"), zero("open_kinds"), "latest")
    return joined.orderBy(F.desc("sent"), F.desc("approved"), F.desc_nulls_last("latest"), "c_name", "c_custkey")


@query(
    "scope_counts",
    """
SELECT count(*) AS everything, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS done,
  count(*) FILTER (o_orderstatus = 'P') AS partial, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 200000) AS large FROM orders
""",
)
def scope_counts(t: Tables) -> DataFrame:
    """Six counts in one pass."""
    return t.orders.agg(
        F.count("*").alias("everything"), *[F.count_if(c).alias(n) for n, c in {"open": F.col("o_orderstatus") == "O", "done": F.col("o_orderstatus") == "F", "partial": F.col("o_orderstatus") == "P", "urgent": F.col("o_orderpriority") == "1-URGENT", "large": F.col("o_totalprice") > 200000}.items()]
    )


@query(
    "progress_by_level",
    """
WITH p AS (SELECT o_orderpriority AS level, count(*) AS planned FROM orders GROUP BY 1),
s AS (SELECT o_orderpriority AS level, count(*) AS sent FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1),
a AS (SELECT CASE WHEN l_linenumber = 7 THEN 'other' ELSE o_orderpriority END AS level, count(*) AS approved FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber IN (1, 7) AND o_orderstatus = 'F' GROUP BY 1)
SELECT level, coalesce(planned, 0) AS planned, coalesce(sent, 0) AS sent, coalesce(approved, 0) AS approved, greatest(0, coalesce(planned, 0) - coalesce(approved, 0)) AS remaining, coalesce(approved, 0) >= coalesce(planned, 0) AS complete
FROM p FULL JOIN s USING (level) FULL JOIN a USING (level)
""",
)
def progress_by_level(t: Tables) -> DataFrame:
    """Planned, sent and approved by level: the union of three tables' keys."""
    level = F.col("o_orderpriority").alias("level")
    approved = t.lineitem.where("l_linenumber in (1, 7)").join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    approved = approved.select(F.when(F.col("l_linenumber") == 7, "other").otherwise(F.col("o_orderpriority")).alias("level"))
    out = R.progress({"planned": t.orders.select(level), "sent": t.orders.where("o_orderstatus <> 'O'").select(level), "approved": approved}, "level")
    return out.select("*", F.greatest(F.lit(0), F.col("planned") - F.col("approved")).alias("remaining"), (F.col("approved") >= F.col("planned")).alias("complete"))


@query("unambiguous_level", "SELECT p_retailprice, min(p_brand) AS p_brand FROM part GROUP BY p_retailprice HAVING count(DISTINCT p_brand) = 1")
def unambiguous_level(t: Tables) -> DataFrame:
    """Prices that one brand only has."""
    return R.unambiguous(t.part, "p_retailprice", "p_brand")


@query("year_union", "SELECT DISTINCT y::INTEGER AS y FROM (SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(l_shipdate) FROM lineitem UNION SELECT year(ts) FROM events)")
def year_union(t: Tables) -> DataFrame:
    """The years of three tables, latest first."""
    years = [df.select(F.year(c).alias("y")).distinct() for df, c in ((t.orders, "o_orderdate"), (t.lineitem, "l_shipdate"), (t.events, "ts"))]
    return years[0].union(years[1]).union(years[2]).distinct().orderBy(F.desc("y"))


@query(
    "academic_year",
    """
SELECT (year(o_orderdate) - (month(o_orderdate) < 9)::INTEGER)::VARCHAR || '/' || (year(o_orderdate) - (month(o_orderdate) < 9)::INTEGER + 1)::VARCHAR AS academic_year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""",
)
def academic_year(t: Tables) -> DataFrame:
    """Orders by academic year."""
    return t.orders.groupBy(R.academic_year(F.col("o_orderdate")).alias("academic_year")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "modal_weighted",
    """
WITH m AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
mode AS (SELECT l_suppkey, l_linenumber AS modal FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_linenumber) AS k FROM m) WHERE k = 1),
s AS (SELECT l_suppkey, list(l_quantity ORDER BY l_quantity) AS q, median(l_quantity) AS median FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, modal, median, q[round_even((len(q) - 1) * 0.9, 0)::INTEGER + 1] AS p90 FROM s JOIN mode USING (l_suppkey)
""",
)
def modal_weighted(t: Tables) -> DataFrame:
    """Weighted mode (ties to the least), median, and nearest-rank percentile with half-even rounding of the rank.

    The percentile walks cumulative counts of distinct values, so no group's values are gathered.
    """
    sums = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("w"))
    mode = sums.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct(F.col("w"), -F.col("l_linenumber"))).alias("modal"))
    counts = t.lineitem.groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("c"))
    order = Window.partitionBy("l_suppkey").orderBy("l_quantity")
    walked = counts.select("l_suppkey", "l_quantity", F.sum("c").over(order).alias("upto"), F.sum("c").over(Window.partitionBy("l_suppkey")).alias("n"))
    rank = F.bround((F.col("n") - 1) * 0.9, 0) + 1
    p90 = walked.where(F.col("upto") >= rank).groupBy("l_suppkey").agg(F.min("l_quantity").alias("p90"))
    low, high = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    median = walked.groupBy("l_suppkey").agg(((F.min(F.when(F.col("upto") >= low, F.col("l_quantity"))) + F.min(F.when(F.col("upto") >= high, F.col("l_quantity")))) / 2).alias("median"))
    return mode.join(median, "l_suppkey").join(p90, "l_suppkey")
