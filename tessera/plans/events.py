"""Event queries: users are runs, event types their transitions, props the payload."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.streaming import liveness as L
from tessera.streaming import watchdog as W
from tessera.streaming.folds import folded

from .query import Tables, query


@query(
    "heartbeat_sessions",
    """
WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS beats FROM s GROUP BY user_id, session
""",
)
def heartbeat_sessions(t: Tables) -> DataFrame:
    """Sessions of heartbeats; on a stream the same operator runs with a watermark."""
    return L.heartbeat_sessions(t.events, gap="6 hours")


@query(
    "stalled_runs",
    """
WITH r AS (SELECT user_id, max(ts) AS progress, max(ts) FILTER (event_type = 'purchase') AS bought, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY user_id),
n AS (SELECT max(ts) AS now FROM events),
s AS (SELECT user_id, greatest(progress, bought) AS progress, CASE last WHEN 'error' THEN 'idle' WHEN 'signup' THEN 'pending' ELSE 'processing' END AS state, now FROM r, n)
SELECT user_id, state, progress, epoch(date_trunc('second', now))::BIGINT - epoch(date_trunc('second', progress))::BIGINT > CASE state WHEN 'idle' THEN 90 WHEN 'pending' THEN 300 ELSE 600 END AS stalled FROM s
""",
)
def stalled_runs(t: Tables) -> DataFrame:
    """Runs whose last progress is older than their state allows, at the time of the last event."""
    e = t.events
    runs = e.groupBy("user_id").agg(F.max("ts").alias("p"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("bought"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    state = F.when(F.col("last") == "error", "idle").when(F.col("last") == "signup", "pending").otherwise("processing")
    now = e.agg(F.max("ts").alias("now"))  # one row
    runs = runs.select("user_id", state.alias("state"), L.last_progress(F.col("p"), F.col("bought")).alias("progress")).crossJoin(F.broadcast(now))
    return L.stalled(runs, F.col("now")).select("user_id", "state", "progress", "stalled")


_FOLD = {"signup": "claim", "click": "beat", "view": "beat", "purchase": "completed", "error": "failed"}


@query(
    "run_state_machine",
    """
WITH e AS (SELECT event_id, ts, user_id AS run_id, event_type, user_id % 2 AS own, coalesce(event_id % 2, 0) AS given FROM events),
c AS (SELECT run_id, min((ts, event_id)) AS at, arg_min(given, (ts, event_id)) AS token FROM e WHERE event_type = 'signup' GROUP BY run_id),
f AS (SELECT e.run_id, min((e.ts, e.event_id)) AS at, arg_min(event_type, (e.ts, e.event_id)) AS kind FROM e JOIN c USING (run_id) WHERE (e.ts, e.event_id) > c.at AND given = token AND event_type IN ('purchase', 'error') GROUP BY e.run_id),
b AS (SELECT e.run_id, count(*) AS beats FROM e JOIN c USING (run_id) LEFT JOIN f USING (run_id) WHERE (e.ts, e.event_id) > c.at AND (f.at IS NULL OR (e.ts, e.event_id) < f.at) AND given = token AND event_type IN ('click', 'view') GROUP BY e.run_id),
u AS (SELECT run_id, max(ts) AS updated FROM e GROUP BY run_id)
SELECT u.run_id, CASE f.kind WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE CASE WHEN c.token IS NULL THEN 'pending' ELSE 'running' END END AS status,
  c.token::VARCHAR AS token, coalesce(beats, 0) AS beats, updated FROM u LEFT JOIN c USING (run_id) LEFT JOIN f USING (run_id) LEFT JOIN b USING (run_id)
""",
)
def run_state_machine(t: Tables) -> DataFrame:
    """Each run's state after all its events: claimed once, beats with the claim's token, first end stays."""
    kind = F.create_map(*[F.lit(x) for kv in _FOLD.items() for x in kv])[F.col("event_type")]
    e = t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts", kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("token"))
    return L.run_states_batch(e)


_WATCHED = {"signup": "create", "error": "submit", "click": "claim", "view": "beat", "purchase": "completed"}
_LIMITS = {"idle": 6 * 3600, "pending": 8 * 3600, "processing": 12 * 3600}


@query(
    "watchdog_log",
    """
WITH RECURSIVE e AS (SELECT user_id AS run_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'submit' WHEN 'click' THEN 'claim' WHEN 'view' THEN 'beat' ELSE 'completed' END AS kind,
  (event_id % 2)::VARCHAR AS given, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
u AS (SELECT max(us) AS until FROM e),
w AS (SELECT DISTINCT run_id, 0 AS k, 'none' AS status, NULL::VARCHAR AS token, 0 AS attempt, 0::BIGINT AS progress, NULL::VARCHAR AS cause, 0 AS n FROM e
UNION ALL SELECT run_id, k, status, token, attempt, progress, CASE WHEN status <> before THEN cause WHEN cause = 'stalled' THEN cause END AS cause, n FROM (
  SELECT run_id, status AS before, n + 1 AS n,
    CASE WHEN fires THEN k ELSE k + 1 END AS k,
    CASE WHEN fires THEN 'stalled' ELSE kind END AS cause,
    CASE WHEN fires THEN CASE WHEN attempt + 1 > 3 THEN 'expired' ELSE 'pending' END WHEN creates THEN 'idle' WHEN submits THEN 'pending' WHEN claims THEN 'processing' WHEN held AND kind = 'completed' THEN 'completed' ELSE status END AS status,
    CASE WHEN fires OR creates THEN NULL WHEN claims THEN given ELSE token END AS token,
    CASE WHEN fires THEN attempt + 1 WHEN creates THEN 0 ELSE attempt END AS attempt,
    CASE WHEN fires THEN due WHEN creates OR submits OR claims OR held AND kind IN ('beat', 'completed') THEN us ELSE progress END AS progress
  FROM (SELECT *, coalesce(due < coalesce(us, until + 1), false) AS fires, coalesce(kind = 'create' AND status IN ('none', 'completed', 'expired'), false) AS creates, coalesce(kind = 'submit' AND status = 'idle', false) AS submits,
      coalesce(kind = 'claim' AND status = 'pending', false) AS claims, coalesce(status = 'processing' AND given = token, false) AS held
    FROM (SELECT w.*, e.us, e.kind, e.given, until, w.progress + CASE w.status WHEN 'idle' THEN 21600000000 WHEN 'pending' THEN 28800000000 WHEN 'processing' THEN 43200000000 END AS due
      FROM w LEFT JOIN e ON e.run_id = w.run_id AND e.k = w.k + 1 CROSS JOIN u)
    WHERE us IS NOT NULL OR due <= until)))
SELECT run_id, make_timestamp(progress) AS at, status, token, attempt, cause FROM w WHERE cause IS NOT NULL
""",
)
def watchdog_log(t: Tables) -> DataFrame:
    """All changes of all runs: created, submitted, claimed, done, and given back where they stalled."""
    kind = F.create_map(*[F.lit(x) for kv in _WATCHED.items() for x in kv])[F.col("event_type")]
    e = t.events.select(F.col("user_id").alias("run_id"), "event_id", "ts", kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("token"))
    return W.watched(e, _LIMITS).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "barrier_open",
    """
WITH l AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY ALL), s AS (SELECT user_id % 20 AS subject, CASE WHEN v > 30 THEN 'completed' ELSE 'running' END AS status FROM l)
SELECT subject, count(*) AS runs, count(*) FILTER (status = 'completed') AS over, count(*) FILTER (status = 'completed') < count(*) AS open FROM s GROUP BY subject
""",
)
def barrier_open(t: Tables) -> DataFrame:
    """A subject moves on when all its runs are over."""
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    runs = last.select((F.col("user_id") % 20).alias("subject"), F.when(F.col("v") > 30, "completed").otherwise("running").alias("status"))
    return L.barrier(runs, "subject")


@query(
    "consecutive_runs",
    """
WITH e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM e GROUP BY user_id, event_type, island HAVING count(*) >= 3
""",
)
def consecutive_runs(t: Tables) -> DataFrame:
    """Three or more events of one type in a row."""
    order = [F.col("ts"), F.col("event_id")]
    island = F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    e = t.events.select("user_id", "event_id", "event_type", "ts").withColumn("island", island)
    return e.groupBy("user_id", "event_type", "island").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).where("n >= 3").drop("island")


@query("json_props", "SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, max((props->>'$.k')::BIGINT) AS most FROM events WHERE (props->>'$.k')::BIGINT >= 10 GROUP BY event_type")
def json_props(t: Tables) -> DataFrame:
    """A field of the payload, filtered and summed."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t.events.select("event_type", k.alias("k")).where("k >= 10").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def chain(events: DataFrame, by: str, order: list[str], payload: str) -> DataFrame:
    """(by, head, length): each row's digest covers the one before; a chain is one fold, in one task."""

    def link(state: tuple[str, int], p: str | None) -> tuple[str, int]:
        return hashlib.sha256((state[0] + ("" if p is None else p)).encode()).hexdigest(), state[1] + 1

    return folded(events, by, order, [payload], ("", 0), link, lambda state: state, f"{by} long, head string, length long")


@query(
    "hash_chain",
    """
WITH RECURSIVE e AS (SELECT user_id, event_type || ':' || event_id::VARCHAR AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
c AS (SELECT user_id, k, sha256(payload) AS head FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, sha256(c.head || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.k = c.k + 1)
SELECT user_id, head, k AS length FROM c WHERE (user_id, k) IN (SELECT user_id, max(k) FROM e GROUP BY user_id)
""",
)
def hash_chain(t: Tables) -> DataFrame:
    """Every user's chain of event digests."""
    e = t.events.select("user_id", "ts", "event_id", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("payload"))
    return chain(e, "user_id", ["ts", "event_id"], "payload")
