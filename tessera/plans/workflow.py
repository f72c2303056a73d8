"""Workflow queries: orders are subjects and tasks, customers users, nations units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import workflow as W

from .query import Tables, query


@query("latest_per_group", "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_group(t: Tables) -> DataFrame:
    """A run's latest event of each type."""
    return W.latest(t.events.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])


@query(
    "attempt_history",
    """
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(CASE WHEN value > 50 THEN ts END, ts), event_id)::INTEGER AS attempt,
  CASE WHEN value IS NULL THEN 'open' ELSE 'decided' END AS state FROM events
""",
)
def attempt_history(t: Tables) -> DataFrame:
    """Attempts numbered within a step by activation, else creation time."""
    time = F.coalesce(F.when(F.col("value") > 50, F.col("ts")), F.col("ts"))
    got = W.attempts(t.events, ["user_id", "event_type"], [time, F.asc("event_id")])
    return got.select("event_id", "user_id", "event_type", "attempt", F.when(F.col("value").isNull(), "open").otherwise("decided").alias("state"))


_RULES = "(1, '1-URGENT', 'F', 5), (2, '1-URGENT', NULL, 9), (3, NULL, 'O', 7), (4, NULL, NULL, 1), (5, '2-HIGH', 'O', 3), (6, '2-HIGH', 'O', 4)"


@query(
    "route_choice",
    f"""
WITH rules(rule_id, rule_kind, rule_group, priority) AS (VALUES {_RULES})
SELECT o_orderkey, kind, grp, rule_id FROM (
  SELECT o_orderkey, o_orderpriority AS kind, o_orderstatus AS grp, rule_id,
    row_number() OVER (PARTITION BY o_orderkey ORDER BY rule_kind IS NULL, rule_group IS NULL, priority DESC, rule_id) AS k
  FROM orders JOIN rules ON (rule_kind IS NULL OR rule_kind = o_orderpriority) AND (rule_group IS NULL OR rule_group = o_orderstatus)) WHERE k = 1
""",
)
def route_choice(t: Tables) -> DataFrame:
    """Null-wildcard rules by specificity, priority and id."""
    rules = F.broadcast(t.spark.sql(f"SELECT * FROM VALUES {_RULES} AS r(rule_id, rule_kind, rule_group, priority)"))  # six rows
    subjects = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("grp"))
    return W.route_choice(subjects, rules, "o_orderkey").select("o_orderkey", "kind", "grp", "rule_id")


_TASKS = """
tasks AS (SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS task_user, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS task_group, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 25 END AS task_unit FROM orders),
users AS (SELECT c_custkey AS user_id, CASE c_custkey % 2 WHEN 0 THEN '1-URGENT' ELSE '2-HIGH' END AS user_group, c_nationkey AS user_unit FROM customer)"""


def _tasks(t: Tables) -> tuple[DataFrame, DataFrame]:
    tasks = t.orders.select(
        F.col("o_orderkey").alias("task_id"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).alias("task_user"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("task_group"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 25).alias("task_unit"),
    )
    users = t.customer.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("user_group"), F.col("c_nationkey").alias("user_unit"))
    return tasks, users


@query(
    "task_visibility",
    f"""
WITH {_TASKS},
seen AS (SELECT user_id, task_id, true AS own FROM users JOIN tasks ON task_user = user_id
  UNION ALL SELECT user_id, task_id, false FROM users JOIN tasks ON task_user IS NULL AND task_group = user_group AND task_unit IS NULL
  UNION ALL SELECT user_id, task_id, false FROM users JOIN tasks ON task_user IS NULL AND task_group = user_group AND task_unit = user_unit)
SELECT u.user_id, count(task_id) AS visible, count(task_id) FILTER (own) AS personal FROM users u LEFT JOIN seen USING (user_id) GROUP BY u.user_id
""",
)
def task_visibility(t: Tables) -> DataFrame:
    """Tasks that each user sees, and the personal ones.

    The alternatives exclude each other (a task that names a user names no group), so each is an equi-join of counts:
    no pair of user and task is formed.
    """
    tasks, users = _tasks(t)
    personal = tasks.where("task_user is not null").groupBy(F.col("task_user").alias("user_id")).agg(F.count_distinct("task_id").alias("personal"))
    group = tasks.where("task_user is null").groupBy("task_group", "task_unit").agg(F.count_distinct("task_id").alias("n"))
    anywhere = group.where("task_unit is null").select(F.col("task_group").alias("user_group"), F.col("n").alias("anywhere"))
    within = group.where("task_unit is not null").select(F.col("task_group").alias("user_group"), F.col("task_unit").alias("user_unit"), F.col("n").alias("within"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return users.join(personal, "user_id", "left").join(anywhere, "user_group", "left").join(within, ["user_group", "user_unit"], "left").select("user_id", (zero("personal") + zero("anywhere") + zero("within")).alias("visible"), zero("personal").alias("personal"))


@query(
    "inbox_tabs",
    f"""
WITH {_TASKS}
SELECT coalesce(task_group, 'personal') AS tab, count(*) AS n, count(*) FILTER (task_unit IS NOT NULL) AS in_unit FROM tasks GROUP BY 1
""",
)
def inbox_tabs(t: Tables) -> DataFrame:
    """Counts by tab."""
    tasks, _ = _tasks(t)
    return tasks.groupBy(F.coalesce("task_group", F.lit("personal")).alias("tab")).agg(F.count("*").alias("n"), F.count_if(F.col("task_unit").isNotNull()).alias("in_unit"))


@query("stale_prune", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate >= TIMESTAMP '1996-01-01')")
def stale_prune(t: Tables) -> DataFrame:
    """Plans without a recent fact."""
    seen = t.lineitem.where("l_shipdate >= timestamp '1996-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(seen, "o_orderkey", "left_anti").select("o_orderkey", "o_orderstatus")


@query(
    "upsert_merge",
    """
WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS status, round(o_totalprice, 2) AS price, o_orderkey % 7 = 0 AS held FROM orders WHERE o_orderkey % 5 <> 0),
i AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS status, round(CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS price FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT coalesce(s.k, i.k) AS k, s.k AS sk, i.k AS ik, s.status AS ss, i.status AS si, s.price AS ps, i.price AS pi, coalesce(held, false) AS held FROM s FULL JOIN i ON s.k = i.k),
r AS (SELECT *, CASE WHEN sk IS NULL THEN si WHEN ik IS NULL OR held THEN ss ELSE si END AS status, CASE WHEN sk IS NULL THEN pi WHEN ik IS NULL THEN ps ELSE pi END AS price FROM b)
SELECT k, status, price, held, CASE WHEN sk IS NULL THEN 'create' WHEN ik IS NULL THEN 'stale' WHEN status IS DISTINCT FROM ss OR price IS DISTINCT FROM ps THEN 'update' ELSE 'keep' END AS action FROM r
""",
)
def upsert_merge(t: Tables) -> DataFrame:
    """Created, updated, kept and stale rows; held rows take the price only."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    stored = t.orders.where(k % 5 != 0).select(k.alias("k"), F.col("o_orderstatus").alias("status"), F.round(price, 2).alias("price"), (k % 7 == 0).alias("held"))
    incoming = t.orders.where(k % 3 != 0).select(k.alias("k"), F.when(k % 4 == 0, "X").otherwise(F.col("o_orderstatus")).alias("status"), F.round(F.when(k % 6 == 0, price + 1).otherwise(price), 2).alias("price"))
    return W.upsert(stored, incoming, "k", ["status", "price"], "held", ["price"])


@query(
    "cross_missing_checks",
    """
WITH d(code) AS (VALUES ('signup'), ('purchase'), ('error'), ('review')), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, code FROM u CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = d.code AND e.value > 90)
""",
)
def cross_missing_checks(t: Tables) -> DataFrame:
    """Definitions that a subject has no run of yet."""
    codes = t.spark.sql("SELECT * FROM VALUES ('signup'), ('purchase'), ('error'), ('review') AS d(code)")
    existing = t.events.where("value > 90").select("user_id", F.col("event_type").alias("code")).distinct()
    return W.missing_pairs(t.events.select("user_id").distinct(), codes, existing, ["user_id", "code"])


@query("ordered_insert", "SELECT l_orderkey, l_linenumber AS was, CASE WHEN l_linenumber >= 3 THEN l_linenumber + 2 ELSE l_linenumber END::INTEGER AS step FROM lineitem")
def ordered_insert(t: Tables) -> DataFrame:
    """Two steps are put in before the third of each route."""
    steps = t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("was"), F.col("l_linenumber").alias("step"))
    return W.renumbered(steps, ["l_orderkey"], "step", 3, 2)
