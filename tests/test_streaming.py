"""The streams give what the tables give."""

import datetime as dt
import time

from pyspark.sql import functions as F

from tessera.streaming import liveness as L

SF = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, df):
    path = str(tmp_path / "in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def _run(df, tmp_path, mode):
    """Rows after the first batch: with processing-time timeouts a stream goes on for ever."""
    q = df.writeStream.format("memory").queryName("got").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        until = time.time() + 60
        while time.time() < until and q.isActive and not any(p["numInputRows"] for p in q.recentProgress):
            time.sleep(0.2)
        return df.sparkSession.table("got").collect()
    finally:
        q.stop()


def test_sessions_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    want = {tuple(r) for r in L.heartbeat_sessions(events, "6 hours").collect()}
    got = {tuple(r) for r in _run(L.heartbeat_sessions(_stream(spark, tmp_path, events), "6 hours"), tmp_path, "complete")}
    assert got == want and len(want) > 10


def test_state_machine_stream_equals_batch(spark, tmp_path):
    kind = F.element_at(F.array(*map(F.lit, ["claim", "beat", "beat", "completed", "failed", "reset"])), (F.col("event_id") % 6 + 1).cast("int"))
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.col("event_id") % 2).cast("string").alias("token"))
    want = {(r.run_id, r.status, r.token, r.beats) for r in L.run_states_batch(events).collect()}
    got = {(r.run_id, r.status, r.token, r.beats) for r in _run(L.run_states(_stream(spark, tmp_path, events.repartition(1))), tmp_path, "update")}
    assert got == want and len({w[1] for w in want}) > 1


def test_transitions():
    assert L.step("pending", None, 0, "claim", "t") == ("running", "t", 0)
    assert L.step("running", "t", 0, "beat", "t") == ("running", "t", 1)
    assert L.step("running", "t", 1, "beat", "other") == ("running", "t", 1)
    assert L.step("running", "t", 1, "completed", "t") == ("completed", "t", 1)
    assert L.step("completed", "t", 1, "claim", "u") == ("completed", "t", 1)


def test_stall_boundaries(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(s, g, now - dt.timedelta(seconds=g)) for s, limit in L.STALL_SECONDS.items() for g in (limit - 1, limit, limit + 1)] + [("idle", 0, None), ("done", 9999, now - dt.timedelta(seconds=9999))]
    got = L.stalled(spark.createDataFrame(rows, "state string, gap int, progress timestamp"), F.lit(now)).collect()
    for r in got:
        assert r.stalled == (r.progress is not None and r.state in L.STALL_SECONDS and r.gap > L.STALL_SECONDS[r.state])
