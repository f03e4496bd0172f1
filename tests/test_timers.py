"""Timers: the processors on a made-up clock, and a stream whose last burst needs no later event."""

import json
import time

import pandas as pd
import pytest

from tidewake.streaming import timers


class Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


class State(dict):
    """Of a map or one value."""

    containsKey, getValue, updateValue, iterator = dict.__contains__, dict.get, dict.__setitem__, dict.items

    def exists(self):
        return bool(self)

    def update(self, value):
        self[()] = value


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, State())

    getValueState = getMapState

    def listTimers(self):
        return iter(sorted(self.timers))

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Run:
    """A processor with one key on a clock that the test moves."""

    def __init__(self, processor):
        self.p, self.handle, self.clock = processor, Handle(), Clock()
        self.p.init(self.handle)

    def __call__(self, now, **columns):
        self.clock.now = now
        out = []
        for at in sorted(t for t in self.handle.timers if t <= now):
            self.handle.deleteTimer(at)
            out += self.p.handleExpiredTimer(("c",), self.clock, None)
        if columns:
            out += self.p.handleInputRows(("c",), iter([pd.DataFrame(columns)]), self.clock)
        return [(r.paths, r.events) for df in out for r in df.itertuples()]


def test_each_event_puts_the_burst_off():
    run = Run(timers.Bursts(2_000))
    assert run(0, path=["a", "b", "a"]) == [] and run(1_500, path=["a"]) == []
    assert run(2_000) == [] and run(3_400, path=["c"]) == [] and run(5_399) == []
    assert run(5_400) == [(["a", "b", "c"], 5)]
    assert run(99_000) == [] and not run.handle.timers
    assert run(99_001, path=["d"]) == [] and run(101_001) == [(["d"], 1)]


def test_paths_wait_for_a_job_or_its_time_to_live():
    run = Run(timers.Deferred(10_000))
    assert run(0, path=["a"], kind=["path"]) == [(["a"], 1)]
    assert run(1, path=["", "b"], kind=["start", "path"]) == [] and run(5, path=["c", "b"], kind=["path"] * 2) == []
    assert run(6, path=["", "d"], kind=["end", "path"]) == [(["b", "c", "d"], 3)] and not run.handle.timers
    assert run(7, path=["", "e"], kind=["start", "path"]) == [] and run(10_006) == []
    assert run(10_007) == [(["e"], 1)] and run(10_008, path=["f"], kind=["path"]) == [(["f"], 1)]


def put(path, name, paths):
    (path / name).write_text("".join(json.dumps({"codebase_id": "c", "path": p}) + "\n" for p in paths))


def test_the_last_burst_needs_no_later_event_and_outlives_a_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    src, batches = tmp_path / "in", {}
    src.mkdir()
    kept = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def start(quiet_ms):
        events = spark.readStream.schema("codebase_id string, path string").json(str(src))
        out = timers.bursts(events, quiet_ms)
        write = lambda df, n: batches.update({n: [(tuple(r["paths"]), r["events"]) for r in df.collect()]})  # a batch that is run again takes its own place
        return out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def got():
        return [x for n in sorted(batches) for x in batches[n]]

    def wait(done, seconds=150):
        end = time.time() + seconds
        while not done() and time.time() < end:
            assert q.exception() is None
            time.sleep(0.3)

    try:
        put(src, "1.json", ["b", "a", "b"])
        q = start(2_000)
        wait(got)
        assert got() == [(("a", "b"), 3)]
        q.stop()
        q = start(15_000)  # long enough to be stopped while the burst waits
        put(src, "2.json", ["z"])
        wait(lambda: any((p["stateOperators"] or [{}])[0].get("numRowsTotal", 0) and p["numInputRows"] for p in q.recentProgress))
        q.stop()
        q = start(15_000)
        wait(lambda: len(got()) > 1)
        assert got()[1:] == [(("z",), 1)]
    finally:
        for q in spark.streams.active:
            q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", kept[0])
        if kept[1]:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept[1])
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
