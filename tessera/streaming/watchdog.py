"""A watchdog over runs: each is created, submitted, claimed by a worker and kept alive by its beats; one that makes no progress
for longer than its state allows is given back, and given up after several times.

One rule for tables and streams: what happens to a run follows from its events in the order of their times, and from its
deadlines between them.  A stream keeps the events that the watermark hasn't passed, by time and id, and takes them in
order once it has; so events in any order, and events delivered twice, give what the table gives.  An event that comes
after the watermark has passed its time is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.ship import ship

from .liveness import STALL_SECONDS

MOST_ATTEMPTS = 3
_LOG = "run_id long, us long, status string, token string, attempt int, cause string"


class Run(NamedTuple):
    """``progress``: when the run last moved, in microseconds; ``token``: the worker's that holds it."""

    status: str = "none"
    token: str | None = None
    attempt: int = 0
    progress: int = 0


Entry = tuple[int, str, str | None, int, str]


def due(run: Run, limits: dict[str, int]) -> int | None:
    """When the run stalls; None where it may rest."""
    return run.progress + limits[run.status] * 1_000_000 if run.status in limits else None


def stalls(run: Run, before: int, limits: dict[str, int], most: int) -> tuple[Run, list[Entry]]:
    """The run after its deadlines before a time: given back without its token, so that the worker that lost it has no say."""
    log: list[Entry] = []
    while (at := due(run, limits)) is not None and at < before:
        run = Run("expired" if run.attempt + 1 > most else "pending", None, run.attempt + 1, at)
        log.append((at, run.status, None, run.attempt, "stalled"))
    return run, log


def moved(run: Run, us: int, kind: str, token: str | None) -> Run:
    """The run after an event; one that doesn't fit its state, or comes with another token, changes nothing."""
    if kind == "create" and run.status in ("none", "completed", "failed", "expired"):
        return Run("idle", None, 0, us)
    if kind == "submit" and run.status == "idle":
        return run._replace(status="pending", progress=us)
    if kind == "claim" and run.status == "pending" and token is not None:
        return run._replace(status="processing", token=token, progress=us)
    if run.status == "processing" and token == run.token:
        if kind == "beat":
            return run._replace(progress=us)
        if kind in ("completed", "failed"):
            return run._replace(status=kind, progress=us)
    return run


def after(run: Run, us: int, kind: str, token: str | None, limits: dict[str, int], most: int) -> tuple[Run, list[Entry]]:
    """The run after its deadlines before an event, and after the event; beats aren't logged."""
    run, log = stalls(run, us, limits, most)
    new = moved(run, us, kind, token)
    if new.status != run.status:
        log.append((us, new.status, new.token, new.attempt, kind))
    return new, log


def _named(log: DataFrame) -> DataFrame:
    return log.select("run_id", F.timestamp_micros("us").alias("at"), "status", "token", "attempt", "cause")


def _keyed(events: DataFrame) -> DataFrame:
    timed = events.where("run_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    plain = [F.col("run_id").cast("long"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), F.coalesce("kind", F.lit("")).alias("kind"), F.col("token").cast("string")]
    return timed.select(*plain, "ts", F.unix_micros("ts").alias("us"))


def watched(events: DataFrame, limits: dict[str, int] | None = None, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(run_id, at, status, token, attempt, cause): each change of each run, up to the time of the table's last event.

    ``events``: (run_id, event_id, ts, kind, token); ``limits``: seconds by state.  A run's events are read in order in one
    task, batch by batch, and none is held.  Rows without a run or a time are left out; an event
    that is there twice changes nothing the second time; events of one time go by their ids, those without an id first.
    """
    ship(events.sparkSession)
    limits = STALL_SECONDS if limits is None else limits

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, run, until, out = None, Run(), 0, []
        for pdf in batches:
            for r, us, kind, token, end in zip(*(pdf[c].tolist() for c in ("run_id", "us", "kind", "token", "until"))):
                if r != key:
                    out += [(key, *x) for x in stalls(run, until + 1, limits, most)[1]]
                    key, run = r, Run()
                run, log = after(run, us, kind, token, limits, most)
                out += [(key, *x) for x in log]
                until = end
            yield pd.DataFrame(out, columns=["run_id", "us", "status", "token", "attempt", "cause"])
            out = []
        yield pd.DataFrame([(key, *x) for x in stalls(run, until + 1, limits, most)[1]], columns=["run_id", "us", "status", "token", "attempt", "cause"])

    e = _keyed(events).drop("ts")
    last = e.agg(F.max("us").alias("until"))  # one row
    ordered = e.crossJoin(F.broadcast(last)).repartition("run_id").sortWithinPartitions("run_id", "us", "event_id", "kind", "token")
    return _named(ordered.mapInPandas(fold, _LOG))


class Watchdog(StatefulProcessor):
    """Keeps a run and the events that wait for the watermark; wakes at the first of them, or at the run's deadline."""

    def __init__(self, limits: dict[str, int], most: int) -> None:
        self.limits, self.most = limits, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, token string, attempt int, progress long")
        self.waiting = handle.getMapState("waiting", "us long, event_id long, kind string", "token string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = None
        for r in rows:
            self.waiting.updateValue((r.us, r.event_id, r.kind), (r.token,))
            first = r.us if first is None else min(first, r.us)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        through = timerValues.getCurrentWatermarkInMs() * 1000
        run = Run(*self.run.get()) if self.run.exists() else Run()
        ready, later = [], None
        for k, v in self.waiting.iterator():
            if k[0] <= through:
                ready.append((tuple(k), v[0]))
            else:
                later = k[0] if later is None else min(later, k[0])
        log: list[Entry] = []
        for k, token in sorted(ready, key=lambda e: (e[0], e[1] or "")):
            run, new = after(run, k[0], k[2], token, self.limits, self.most)
            log += new
            self.waiting.removeKey(k)
        run, new = stalls(run, through + 1, self.limits, self.most)
        if (end := due(run, self.limits)) is None:
            self.run.clear()  # a run that is over waits for its next creation, as one that never was
        else:
            self.run.update(tuple(run))
            later = end if later is None else min(later, end)
        if later is not None:
            self._wake(later)
        return iter([Row(run_id=key[0], us=e[0], status=e[1], token=e[2], attempt=e[3], cause=e[4]) for e in log + new])

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def watched_stream(events: DataFrame, delay: str = "10 minutes", limits: dict[str, int] | None = None, most: int = MOST_ATTEMPTS) -> DataFrame:
    """What ``watched`` gives, on a stream, of all times that the watermark has passed; ``delay``: how late an event may come.
    Needs the RocksDB state store.  State: a row a living run, and the events of the last ``delay``."""
    ship(events.sparkSession)
    log = _keyed(events).withWatermark("ts", delay).groupBy("run_id").transformWithState(Watchdog(STALL_SECONDS if limits is None else limits, most), _LOG, "append", "EventTime")
    return _named(log)
