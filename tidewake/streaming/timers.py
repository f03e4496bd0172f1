"""Bursts and deferral by processing-time timers: what waits is sent when it is due, whether or not another event comes.

A session window ends when the watermark passes it, so the last burst of a quiet source
would wait for the next event. Here each codebase has its paths as keyed state and one timer,
which every batch of its events puts off by the quiet time; when the timer runs out, the
burst is sent and the state is cleared. State and timers lie in the checkpoint, so a query
that is restarted sends what was waiting. State of sources that never came to rest, or of
jobs whose end was lost, goes after a time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

QUIET_MS, KEEP_MS, JOB_MS = 2_000, 3_600_000, 86_400_000
BURST = "codebase_id string, paths array<string>, events long"


def ready(spark: SparkSession) -> SparkSession:
    """Timers need a state store that keeps several tables for each key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class Bursts(StatefulProcessor):
    """Paths with the number of their events, until none has come for the quiet time."""

    def __init__(self, quiet_ms: int = QUIET_MS, keep_ms: int = KEEP_MS):
        self.quiet_ms, self.keep_ms = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "events long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for path, n in pdf["path"].value_counts().items():
                before = self.paths.getValue((path,))[0] if self.paths.containsKey((path,)) else 0
                self.paths.updateValue((path,), (int(n) + before,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = sorted((k[0], v[0]) for k, v in self.paths.iterator())
        self.paths.clear()
        if held:
            yield pd.DataFrame({"codebase_id": [key[0]], "paths": [[p for p, _ in held]], "events": [sum(n for _, n in held)]})

    def close(self) -> None:
        pass


class Deferred(StatefulProcessor):
    """Paths that come while a job is live, until it ends; a job whose end never comes is forgotten after its time to live, and a timer then sends what waited."""

    def __init__(self, job_ms: int = JOB_MS):
        self.job_ms = job_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", "since long")
        self.paths = handle.getMapState("paths", "path string", "events long")

    def _sent(self, key: tuple, more: list[str] = ()) -> Iterator[pd.DataFrame]:
        paths = sorted({k[0] for k, _ in self.paths.iterator()} | set(more))
        self.paths.clear()
        if paths:
            yield pd.DataFrame({"codebase_id": [key[0]], "paths": [paths], "events": [len(paths)]})

    def _timers(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now, ready_now = timerValues.getCurrentProcessingTimeInMs(), []
        for pdf in rows:
            for path, kind in zip(pdf["path"], pdf["kind"]):
                if kind == "start":
                    self.live.update((now,))
                    self._timers(now + self.job_ms)
                elif kind == "end":
                    self.live.clear()
                    self._timers(None)
                    ready_now += [k[0] for k, _ in self.paths.iterator()]
                    self.paths.clear()
                elif self.live.exists():
                    self.paths.updateValue((path,), (1,))
                else:
                    ready_now.append(path)
        if ready_now:
            paths = sorted(set(ready_now))
            yield pd.DataFrame({"codebase_id": [key[0]], "paths": [paths], "events": [len(paths)]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.live.clear()
        yield from self._sent(key)

    def close(self) -> None:
        pass


def bursts(events: DataFrame, quiet_ms: int = QUIET_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """(codebase_id, paths, events) of a stream (codebase_id, path): a row for each burst, sent a quiet time after its last event."""
    ready(events.sparkSession)
    return events.groupBy("codebase_id").transformWithStateInPandas(Bursts(quiet_ms, keep_ms), BURST, "Update", "ProcessingTime")


def deferred(events: DataFrame, job_ms: int = JOB_MS) -> DataFrame:
    """(codebase_id, paths, events) of a stream (codebase_id, path, kind) with kind start, end or path: paths that come while a job is live wait until it ends."""
    ready(events.sparkSession)
    return events.groupBy("codebase_id").transformWithStateInPandas(Deferred(job_ms), BURST, "Update", "ProcessingTime")
