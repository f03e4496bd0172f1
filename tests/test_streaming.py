"""Event streams on files, run to their end."""

import json

from pyspark.sql import functions as F

from tidewake.streaming import events as E


def put(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def event(s, path, is_dir=False):
    return {"ts": f"2024-01-01T00:00:{s:02d}Z", "path": path, "is_dir": is_dir}


def roots(spark):
    return spark.createDataFrame([("outer", "/w"), ("inner", "/w/sub")], "codebase_id string, root string")


def test_dispatch_and_debounce(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "1.json", [event(0, "/w/a"), event(1, "/w/sub/b"), event(2, "/w/a"), event(3, "/w/d", True), event(3, "/w/.git/x"), event(4, "/else")])
    put(src, "2.json", [event(10, "/w/c"), event(59, "/w/z")])
    bursts = E.debounced(E.dispatched(E.read(spark, str(src), files_per_trigger=1), roots(spark)), delay="1 second")
    q = bursts.writeStream.outputMode("append").format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["codebase_id"], tuple(r["paths"]), r["events"]) for r in spark.table("bursts").collect()}
    assert got >= {("outer", ("a", "sub/b"), 3), ("inner", ("b",), 1), ("outer", ("c",), 1)}


def test_converge_batches(spark, tmp_path):
    src, seen = tmp_path / "in", []
    put(src, "1.json", [event(0, "/w/new"), event(0, "/w/gone"), event(1, "/w/same")])
    put(src, "2.json", [event(50, "/w/later")])
    snap = spark.createDataFrame([("gone", "1", 1, 1), ("same", "2", 1, 2), ("old", "3", 1, 3)], "path string, hash string, device int, inode int")
    disk = spark.createDataFrame([("new", "3", 1, 3), ("same", "2", 1, 2)], "path string, hash string, device int, inode int").withColumn("reason", F.lit(None).cast("string"))
    bursts = E.debounced(E.dispatched(E.read(spark, str(src), files_per_trigger=1), roots(spark)), delay="1 second")
    E.converging(bursts, lambda: snap, lambda: disk, lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert set(seen) >= {("new", "copy", "old"), ("gone", "remove", None), ("same", "noop", None)}


def test_deferred_paths_wait_for_the_job(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("c", "a", "path"), ("c", "", "start"), ("c", "b", "path"), ("c", "b", "path"), ("d", "x", "path"), ("c", "", "end"), ("c", "z", "path")]
    for i, (c, p, k) in enumerate(rows):
        put(src, f"{i}.json", [{"codebase_id": c, "path": p, "kind": k}])
        import os
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    events = E.read(spark, str(src), "codebase_id string, path string, kind string", files_per_trigger=1)
    q = E.deferred(events).writeStream.outputMode("append").format("memory").queryName("ready").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted((r["codebase_id"], tuple(r["paths"])) for r in spark.table("ready").collect()) == [("c", ("a",)), ("c", ("b",)), ("c", ("z",)), ("d", ("x",))]


def test_sweep(spark):
    books = spark.createDataFrame([("a", "code", "indexed"), ("b", "code", "stale"), ("c", "document", "indexed")], "codebase_id string, kind string, status string")
    changed = spark.createDataFrame([("a",), ("b",), ("c",)], "codebase_id string")
    assert [r[0] for r in E.sweep(books, changed).collect()] == ["a"]
