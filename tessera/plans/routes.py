"""Route queries: orders are subjects and runs, line items their decisions and steps, customers users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import routes as R

from .query import Tables, query

_STEPS = "('O', 1, 'chair', 11), ('O', 2, 'review', 12), ('F', 1, 'chair', 21), ('F', 2, 'board', 22), ('F', 3, 'sign', 23), ('P', 1, 'chair', 31)"
_OVERRIDES = "('O', 2, '1-URGENT', 99), ('F', 3, '2-HIGH', 98), ('F', 1, '5-LOW', 97)"


def _steps(t: Tables) -> DataFrame:
    return t.spark.sql(f"SELECT route, place, name, assignee FROM VALUES {_STEPS} AS s(route, place, name, assignee)")


@query(
    "assignment_override",
    f"""
WITH s(route, place, name, assignee) AS (VALUES {_STEPS}), o(route, place, direction, assignee) AS (VALUES {_OVERRIDES})
SELECT o_orderkey, s.route || s.place::VARCHAR AS step, coalesce(o.assignee, s.assignee) AS assignee, CASE WHEN o.assignee IS NOT NULL THEN 'direction' ELSE 'template' END AS source
FROM orders JOIN s ON s.route = o_orderstatus LEFT JOIN o ON o.route = s.route AND o.place = s.place AND o.direction = o_orderpriority
""",
)
def assignment_override(t: Tables) -> DataFrame:
    """Assignees by direction, else by the template."""
    steps = _steps(t).select("route", F.concat("route", F.col("place").cast("string")).alias("step"), "assignee")
    over = t.spark.sql(f"SELECT concat(route, cast(place AS string)) AS step, direction, assignee FROM VALUES {_OVERRIDES} AS o(route, place, direction, assignee)")
    return R.assigned(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("route"), F.col("o_orderpriority").alias("direction")), steps, over, "o_orderkey")


@query(
    "route_steps",
    f"""
WITH s(route, place, name, assignee) AS (VALUES {_STEPS})
SELECT o_orderkey, (o_orderkey % 4 + place)::BIGINT AS place, name FROM orders JOIN s ON route = o_orderstatus WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""",
)
def route_steps(t: Tables) -> DataFrame:
    """A route's steps for runs that aren't active."""
    runs = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("route"), (F.col("o_orderkey") % 4 + 1).alias("start"))
    return R.expanded(runs, _steps(t), t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_DECIDED = "d AS (SELECT l_orderkey AS k, l_linenumber * 1000 + l_suppkey % 1000 AS moment, CASE WHEN l_returnflag = 'R' THEN 'reject' WHEN l_quantity < 6 THEN 'revise' ELSE 'approve' END AS kind FROM lineitem), n AS (SELECT o_orderkey AS k, (1 + o_orderkey % 4)::INTEGER AS n_steps FROM orders)"
_STATES = """o AS (SELECT k, min(moment) AS moment FROM d WHERE kind <> 'approve' GROUP BY k), ok AS (SELECT d.k, min(kind) AS kind, any_value(o.moment) AS moment FROM d JOIN o ON o.k = d.k AND o.moment = d.moment AND kind <> 'approve' GROUP BY d.k),
c AS (SELECT d.k, count(*) AS a FROM d LEFT JOIN o ON o.k = d.k WHERE kind = 'approve' AND (o.moment IS NULL OR d.moment < o.moment) GROUP BY d.k),
r AS (SELECT n.k, n_steps, least(coalesce(a, 0), n_steps)::INTEGER AS approved, kind FROM n LEFT JOIN c ON c.k = n.k LEFT JOIN ok ON ok.k = n.k),
st AS (SELECT k, CASE WHEN approved >= n_steps THEN 'completed' WHEN kind = 'reject' THEN 'rejected' WHEN kind = 'revise' THEN 'paused' ELSE 'active' END AS status, CASE WHEN approved < n_steps AND coalesce(kind, '') <> 'reject' THEN approved + 1 END AS step, approved FROM r)"""


def _states(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_quantity") < 6, "revise").otherwise("approve")
    decisions = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).alias("at"), kind.alias("kind"))
    return R.run_states(decisions, t.orders.select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 4).cast("int").alias("n_steps")), "k")


@query("run_states", f"WITH {_DECIDED}, {_STATES} SELECT k, status, step::INTEGER AS step, approved FROM st")
def run_states(t: Tables) -> DataFrame:
    """Approval runs: completed, rejected, paused or active, and where."""
    return _states(t)


@query(
    "appeal_outcomes",
    f"""
WITH {_DECIDED}, {_STATES}, q AS (SELECT event_id AS request, user_id AS k, ts AS moment FROM events WHERE event_type = 'error')
SELECT request, q.k, CASE WHEN coalesce(status, '') <> 'rejected' THEN 'refused: not rejected' WHEN row_number() OVER (PARTITION BY q.k ORDER BY moment, request) = 1 THEN 'pending' ELSE 'refused: appealed already' END AS outcome FROM q LEFT JOIN st ON st.k = q.k
""",
)
def appeal_outcomes(t: Tables) -> DataFrame:
    """One appeal for each rejected subject."""
    requests = t.events.where("event_type = 'error'").select(F.col("event_id").alias("request"), F.col("user_id").alias("k"), F.col("ts").alias("at"))
    return R.appeals(requests, _states(t).select("k", "status"), "k")


_RUNS = "runs AS (SELECT user_id, event_type AS code, CASE WHEN max(value) > 90 THEN 'done' WHEN max(value) > 60 THEN 'running' ELSE 'pending' END AS status FROM events GROUP BY ALL)"


def _runs(t: Tables) -> DataFrame:
    top = F.max("value")
    return t.events.groupBy("user_id", F.col("event_type").alias("code")).agg(F.when(top > 90, "done").when(top > 60, "running").otherwise("pending").alias("status"))


@query("run_resets", f"WITH {_RUNS}, w AS (SELECT DISTINCT user_id, code FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES ('signup'), ('error'), ('audit')) c(code)) SELECT w.user_id, w.code, CASE WHEN status IS NULL THEN 'create' WHEN status IN ('pending', 'running') THEN 'keep' ELSE 'reset' END AS action FROM w LEFT JOIN runs USING (user_id, code)")
def run_resets(t: Tables) -> DataFrame:
    """Runs to create, to reset and to keep."""
    wanted = t.events.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("signup", "error", "audit")))).alias("code"))
    return R.reset_runs(_runs(t), wanted, ["user_id", "code"])


@query("run_progress", f"WITH {_RUNS} SELECT user_id, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, round_even(100.0 * count(*) FILTER (status = 'done') / 5, 0)::INTEGER AS percent, count(*) FILTER (status = 'done') >= 5 AS finished FROM runs GROUP BY user_id")
def run_progress(t: Tables) -> DataFrame:
    """How far each user's runs are."""
    return R.progress(_runs(t), "user_id", F.lit(5))


@query(
    "source_numbers",
    """
WITH s AS (SELECT l_orderkey AS k, l_suppkey % 20 AS source, min((l_linenumber, l_partkey)) AS f FROM lineitem GROUP BY ALL),
e AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 20 AS source, (l_suppkey % 20)::INTEGER AS number FROM lineitem WHERE l_suppkey % 20 BETWEEN 1 AND 3),
m AS (SELECT k, max(number) AS m FROM e GROUP BY k)
SELECT s.k, s.source, e.number FROM s JOIN e ON e.k = s.k AND e.source = s.source
UNION ALL SELECT s.k, s.source, (coalesce(m, 0) + row_number() OVER (PARTITION BY s.k ORDER BY f, s.source))::INTEGER FROM s LEFT JOIN m ON m.k = s.k WHERE NOT s.source BETWEEN 1 AND 3
""",
)
def source_numbers(t: Tables) -> DataFrame:
    """Sources numbered as they are first seen, after those that have a number."""
    selected = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 20).alias("source"), "l_linenumber", "l_partkey")
    existing = selected.where("source between 1 and 3").select("k", "source", F.col("source").cast("int").alias("number")).distinct()
    return R.source_numbers(selected, existing, "k", "source", ["l_linenumber", "l_partkey", "source"])


@query(
    "fallback_results",
    "WITH p AS (SELECT c_custkey AS k, o_orderkey AS r, 'supports' AS verdict FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'), f AS (SELECT o_custkey AS k, min(o_orderkey) AS r FROM orders GROUP BY 1) SELECT * FROM p UNION ALL SELECT k, r, 'possible' FROM f WHERE k NOT IN (SELECT k FROM p)",
)
def fallback_results(t: Tables) -> DataFrame:
    """A plainer path's result where the first has none."""
    primary = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("k"), F.col("o_orderkey").alias("r"), F.lit("supports").alias("verdict"))
    fallback = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("r")).withColumn("verdict", F.lit("supports"))
    return R.with_fallback(primary, fallback, "k", "verdict", "possible")


@query("composed_filter", "SELECT o_orderkey, o_custkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = 1996 AND (contains(lower(o_orderpriority), 'high') OR contains(lower(c_mktsegment), 'auto')) AND (o_orderstatus = 'F' OR c_mktsegment = 'BUILDING')")
def composed_filter(t: Tables) -> DataFrame:
    """Year, text and kind; the kind may be the linked row's."""
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    text = F.contains(F.lower("o_orderpriority"), F.lit("high")) | F.contains(F.lower("c_mktsegment"), F.lit("auto"))
    kind = (F.col("o_orderstatus") == "F") | (F.col("c_mktsegment") == "BUILDING")
    return R.composed(rows, {"owner": None, "year": F.year("o_orderdate") == 1996, "text": text, "kind": kind}).select("o_orderkey", "o_custkey")


@query("own_or_shared", "SELECT o_custkey AS \"user\", o_orderkey, 'owner' AS how FROM orders UNION ALL SELECT DISTINCT l_suppkey, o_orderkey, 'shared' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey <> o_custkey")
def own_or_shared(t: Tables) -> DataFrame:
    """What a user owns, and what is shared with them."""
    return R.own_or_shared(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("user")), "o_orderkey", "o_custkey")


@query(
    "action_states",
    """
WITH m AS (SELECT s_suppkey AS "user", s_suppkey % 3 AS grp, s_nationkey AS unit FROM supplier),
t AS (SELECT o_orderkey, (o_custkey % 97) AS "user", CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 89 END AS assignee, o_orderkey % 3 AS grp, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 25)::INTEGER END AS unit, CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'closed' END AS status, o_totalprice > 100000 AS rejectable FROM orders),
w AS (SELECT t.*, CASE WHEN assignee IS NOT NULL THEN assignee = t."user" ELSE EXISTS (SELECT 1 FROM m WHERE m."user" = t."user" AND m.grp = t.grp AND (t.unit IS NULL OR m.unit = t.unit)) END AS mine FROM t)
SELECT o_orderkey, "user", status = 'active' AS active, mine, status = 'active' AND mine AND rejectable AS can_reject, CASE WHEN status <> 'active' THEN 'closed' WHEN NOT mine THEN 'not assigned' ELSE '' END AS reason FROM w
""",
)
def action_states(t: Tables) -> DataFrame:
    """What each user may do with a task."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    tasks = t.orders.select(k, (c % 97).alias("user"), F.when(k % 3 == 0, c % 89).alias("assignee"), (k % 3).alias("grp"), F.when(k % 2 == 0, (c % 25).cast("int")).alias("unit"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), (F.col("o_totalprice") > 100000).alias("rejectable"))
    members = t.supplier.select(F.col("s_suppkey").alias("user"), (F.col("s_suppkey") % 3).alias("grp"), F.col("s_nationkey").alias("unit"))
    return R.action_state(tasks, members, "o_orderkey")


@query(
    "nested_steps",
    """
WITH i AS (SELECT l_orderkey, l_linestatus, count(*) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY ALL)
SELECT l_orderkey, count(*) AS groups, string_agg(l_linestatus || '[' || parts || ']', ' ' ORDER BY l_linestatus) AS tree FROM i GROUP BY l_orderkey
""",
)
def nested_steps(t: Tables) -> DataFrame:
    """Steps with their tasks, two levels deep, each gathered in order."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_linenumber"].cast("string")), ",")
    inner = t.lineitem.groupBy("l_orderkey", "l_linestatus").agg(parts.alias("parts"))
    branch = F.transform(F.array_sort(F.collect_list(F.struct("l_linestatus", "parts"))), lambda r: F.concat(r["l_linestatus"], F.lit("["), r["parts"], F.lit("]")))
    return inner.groupBy("l_orderkey").agg(F.count("*").alias("groups"), F.array_join(branch, " ").alias("tree"))


@query("bridge_options", "SELECT DISTINCT n_name, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey WHERE p_size > 40")
def bridge_options(t: Tables) -> DataFrame:
    """Distinct pairs over a many-to-many bridge."""
    b = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    return b.join(t.part.where("p_size > 40"), F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", "p_brand").distinct()


@query("rule_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000) AS has_rule FROM customer")
def rule_exists(t: Tables) -> DataFrame:
    """Whether a rule names a user or their unit."""
    own = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("_u")).distinct()
    unit = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(True).alias("_n")).distinct()
    return t.customer.join(own, "c_custkey", "left").join(unit, "c_nationkey", "left").select("c_custkey", F.coalesce("_u", "_n", F.lit(False)).alias("has_rule"))


@query("active_members", "SELECT DISTINCT n_name, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def active_members(t: Tables) -> DataFrame:
    """A unit's active members of a role."""
    role = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.where("c_acctbal > 0").join(role, "c_custkey", "left_semi").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey")


@query("active_definitions", "SELECT event_type AS code, count(*) AS n, row_number() OVER (ORDER BY event_type)::INTEGER AS place FROM events WHERE event_type NOT IN ('error', 'legacy') GROUP BY event_type")
def active_definitions(t: Tables) -> DataFrame:
    """Definitions in use, without the retired ones, in order."""
    from pyspark.sql import Window

    used = t.events.where(~F.col("event_type").isin("error", "legacy")).groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    return used.withColumn("place", F.row_number().over(Window.orderBy("code")))  # a row a definition


@query("accepted_results", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount * 100 >= 5 AND l_returnflag <> 'R'")
def accepted_results(t: Tables) -> DataFrame:
    """Results over the floor whose verdict isn't against."""
    return t.lineitem.where((F.col("l_discount") * 100 >= 5) & (F.col("l_returnflag") != "R")).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "dependency_targets",
    """
WITH w AS (SELECT page_id, regexp_extract(url, '://[^/]*/(.*)$', 1) || CASE WHEN page_id % 3 = 0 THEN '.X' ELSE '' END AS path FROM pages), e AS (SELECT upper(regexp_extract(url, '://[^/]*/(.*)$', 1)) AS path FROM pages WHERE page_id % 2 = 0),
x AS (SELECT lower(path) AS p, min(path) AS a FROM e GROUP BY 1), s AS (SELECT regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '\\.[^.]*$', '') AS s, min(path) AS b FROM e GROUP BY 1 HAVING count(*) = 1)
SELECT page_id, path, coalesce(a, b) AS target, CASE WHEN a IS NOT NULL THEN 'path' WHEN b IS NOT NULL THEN 'stem' ELSE 'missing' END AS how FROM w LEFT JOIN x ON p = lower(path) LEFT JOIN s ON s = regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '\\.[^.]*$', '')
""",
)
def dependency_targets(t: Tables) -> DataFrame:
    """Dependencies by path, else by their only stem."""
    path = F.regexp_extract("url", "://[^/]*/(.*)$", 1)
    wanted = t.pages.select("page_id", F.concat(path, F.when(F.col("page_id") % 3 == 0, ".X").otherwise("")).alias("path"))
    return R.resolved(wanted, t.pages.where("page_id % 2 = 0").select(F.upper(path).alias("path")), "page_id")


@query(
    "main_files",
    """
WITH f AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN page_id % 7 = 0 THEN 'src/main.tex' ELSE regexp_extract(url, '://[^/]*/(.*)$', 1) END AS path FROM pages)
SELECT host, path FROM f QUALIFY row_number() OVER (PARTITION BY host ORDER BY CASE WHEN regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '^(?:main|article|paper|manuscript)\\.') THEN 0 ELSE 1 END, len(string_split(path, '/')), length(path), path) = 1
""",
)
def main_files(t: Tables) -> DataFrame:
    """The main file of each package."""
    path = F.when(F.col("page_id") % 7 == 0, "src/main.tex").otherwise(F.regexp_extract("url", "://[^/]*/(.*)$", 1))
    return R.main_file(t.pages.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), path.alias("path")), "host")


@query(
    "source_reasons",
    "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'It describes the method' WHEN p_size < 35 THEN 'It reports data' ELSE 'The source is near to the topic' END || CASE WHEN p_partkey % 4 > 0 THEN '; shared terms: ' || array_to_string(string_split(p_name, ' ')[1:2], ', ') ELSE '' END || CASE WHEN p_size % 10 >= 5 THEN '; close in meaning' ELSE '' END || '.' AS reason FROM part",
)
def source_reasons(t: Tables) -> DataFrame:
    """Why a source is proposed, in words."""
    kind = F.when(F.col("p_size") < 20, "method").when(F.col("p_size") < 35, "data").otherwise("other")
    terms = F.when(F.col("p_partkey") % 4 > 0, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    return t.part.select("p_partkey", R.reason(kind, terms, (F.col("p_size") % 10) / 11.0, {"method": "It describes the method", "data": "It reports data"}, 2).alias("reason"))


@query(
    "dashboard",
    "SELECT c_mktsegment AS scope, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS partial, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS earned, count(DISTINCT c_custkey) AS people, max(o_orderdate) AS latest FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1",
)
def dashboard(t: Tables) -> DataFrame:
    """Counts and sums of a start page, in one pass."""
    s = F.col("o_orderstatus")
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("scope"))
    return rows.agg(F.count_if(s == "O").alias("open"), F.count_if(s == "F").alias("finished"), F.count_if(s == "P").alias("partial"), F.round(F.sum(F.when(s == "F", F.col("o_totalprice")).otherwise(0)), 2).alias("earned"), F.count_distinct("c_custkey").alias("people"), F.max("o_orderdate").alias("latest"))
