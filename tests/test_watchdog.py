"""The watchdog's log: a stream, whatever the order and number of deliveries, gives what the table gives."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.streaming import watchdog as W

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "run_id long, event_id long, ts timestamp, kind string, token string"


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _log(df):
    return sorted((r.run_id, r["s"], r.status, r.token, r.attempt, r.cause) for r in df.withColumn("s", F.unix_micros("at") / 1e6 - T0.replace(tzinfo=dt.timezone.utc).timestamp()).collect())


def _rows(*events):
    return [(run, i, None if s is None else _at(s), kind, token) for i, (run, s, kind, token) in enumerate(events)]


def test_life_of_a_run(spark):
    rows = _rows(
        (1, 0, "create", None), (1, 10, "submit", None), (1, 20, "claim", "a"), (1, 30, "claim", "b"), (1, 500, "beat", "a"), (1, 600, "completed", "b"), (1, 1100, "completed", "a"),
        (2, 0, "create", None), (2, 91, "claim", "a"), (2, 700, "beat", "b"), (2, 692, "claim", "b"), (2, 693, "completed", "a"), (2, 694, "failed", "b"),
        (3, 0, "create", None), (3, 90, "submit", None), (None, 5, "create", None), (4, None, "create", None), (5, 5, None, None), (5, 6, "beat", None), (3, 3000, "beat", None),
    )
    got = _log(W.watched(spark.createDataFrame(rows, SCHEMA)))
    assert got == [
        (1, 0.0, "idle", None, 0, "create"), (1, 10.0, "pending", None, 0, "submit"), (1, 20.0, "processing", "a", 0, "claim"), (1, 1100.0, "completed", "a", 0, "completed"),
        (2, 0.0, "idle", None, 0, "create"), (2, 90.0, "pending", None, 1, "stalled"), (2, 91.0, "processing", "a", 1, "claim"), (2, 691.0, "pending", None, 2, "stalled"), (2, 692.0, "processing", "b", 2, "claim"), (2, 694.0, "failed", "b", 2, "failed"),
        (3, 0.0, "idle", None, 0, "create"), (3, 90.0, "pending", None, 0, "submit"), (3, 390.0, "pending", None, 1, "stalled"), (3, 690.0, "pending", None, 2, "stalled"), (3, 990.0, "pending", None, 3, "stalled"), (3, 1290.0, "expired", None, 4, "stalled"),
    ]
    assert _log(W.watched(spark.createDataFrame([], SCHEMA))) == []


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_stream_equals_table(spark, tmp_path, rocks):
    rng = random.Random(5)
    kinds = ["create", "submit", "claim", "beat", "beat", "beat", "completed", "failed"]
    rows = [(rng.randint(1, 12), i, _at(rng.uniform(0, 9000)), rng.choice(kinds), rng.choice("ab")) for i in range(900)]
    end = [(0, 10_000 + i, _at(9000 + 1000 * i), "beat", None) for i in range(1, 4)]
    want = _log(W.watched(spark.createDataFrame([*rows, (0, 9_999, _at(9999), "beat", None)], SCHEMA)))
    # four deliveries: each a stretch of time, out of order, some of the stretch before again, some of the next one early
    rows.sort(key=lambda r: r[2])
    batches = []
    for k in range(4):
        part = rows[225 * k : 225 * (k + 1)]
        part += rng.sample(part, 40) + rows[225 * (k + 1) : 225 * (k + 1) + 10] + (rng.sample(rows[225 * k - 20 : 225 * k], 15) if k else [])
        rng.shuffle(part)
        batches.append(part)
    path = tmp_path / "in"
    path.mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = W.watched_stream(source, "1000 seconds").writeStream.format("memory").queryName("watched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for part in [*batches, end[:1], end[1:2], end[2:]]:
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
            q.processAllAvailable()
        got = _log(spark.table("watched"))
    finally:
        q.stop()
    # the watermark has come to 11,000 seconds: what the table's end at 9,999 leaves open is later
    assert [g for g in got if g[1] <= 9999] == want and len({g[5] for g in got}) == 6
