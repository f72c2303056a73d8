"""Liveness of runs on heartbeat and lifecycle events: sessions, stalls, and a keyed state machine.

Each operator takes a batch or a streaming DataFrame; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.ship import ship

from .folds import folded

#: Seconds without progress after which a run counts as stalled, by state.
STALL_SECONDS = {"idle": 90, "pending": 300, "processing": 600}
TERMINAL = ("completed", "failed", "cancelled")


def heartbeat_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour", by: str = "user_id", time: str = "ts") -> DataFrame:
    """(by, start, end, beats): runs of heartbeats without a pause of ``gap``."""
    # a watermark needs a time with a zone; the session's is taken for times without one
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, watermark) if events.isStreaming else events
    s = timed.groupBy(by, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("beats"))
    return s.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "beats")


def last_progress(*times: Column) -> Column:
    """The latest of several times; nulls don't count."""
    return F.greatest(*times)


def stalled(runs: DataFrame, now: Column, progress: str = "progress", state: str = "state") -> DataFrame:
    """``runs`` with ``stalled``: no progress for longer than the state allows."""
    limit = F.create_map(*[F.lit(x) for kv in STALL_SECONDS.items() for x in kv])[F.col(state)]
    return runs.withColumn("stalled", F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(progress) > limit, F.lit(False)))


_STATE = "status string, token string, beats long, updated timestamp"
_OUT = "run_id long, status string, token string, beats long, updated timestamp"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """pending -> running by a claim token; heartbeats count only with that token; a terminal status stays."""
    status, token, beats, updated = state.get if state.exists else ("pending", None, 0, None)
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([{"run_id": key[0], "status": "stalled", "token": token, "beats": beats, "updated": updated}])
        return
    for pdf in batches:
        for e in pdf.sort_values(["ts", "event_id"]).itertuples():
            status, token, beats = step(status, token, beats, e.kind, e.token)
            updated = e.ts
    state.update((status, token, beats, updated))
    if status in TERMINAL:
        state.remove()
    else:
        state.setTimeoutDuration(STALL_SECONDS["processing"] * 1000)
    yield pd.DataFrame([{"run_id": key[0], "status": status, "token": token, "beats": beats, "updated": updated}])


def step(status: str, token: str | None, beats: int, kind: str, given: str | None) -> tuple[str, str | None, int]:
    """One transition; what doesn't fit the state is ignored, so events may be delivered twice."""
    if status in TERMINAL:
        return status, token, beats
    if kind == "claim" and status == "pending":
        return "running", given, beats
    if kind == "beat" and status == "running" and given == token:
        return status, token, beats + 1
    if kind in TERMINAL and status == "running" and given == token:
        return kind, token, beats
    if kind == "reset":
        return "pending", None, beats
    return status, token, beats


def run_states(events: DataFrame) -> DataFrame:
    """Stream (run_id, event_id, ts, kind, token) to each run's state; a run silent too long is reported as stalled."""
    ship(events.sparkSession)
    return events.groupBy("run_id").applyInPandasWithState(_fold, _OUT, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def run_states_batch(events: DataFrame) -> DataFrame:
    """The same fold over a table."""

    def fold(state: tuple, ts: pd.Timestamp, kind: str, token: str | None) -> tuple:
        return *step(*state[:3], kind, token), ts

    return folded(events, "run_id", ["ts", "event_id"], ["ts", "kind", "token"], ("pending", None, 0, None), fold, lambda state: state, _OUT)


def barrier(runs: DataFrame, subject: str, status: str = "status") -> DataFrame:
    """Subjects with how many runs are over, and whether all are."""
    over = F.col(status).isin(*TERMINAL)
    return runs.groupBy(subject).agg(F.count("*").alias("runs"), F.count_if(over).alias("over")).withColumn("open", F.col("over") < F.col("runs"))
