"""Collections in buckets: what a change writes, what a cut-off one leaves, and how often a sync reads its source."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewake.operators import shaping
from tidewake.plans import sync as syncing
from tidewake.service import Service
from tidewake.sources.collections import BUCKET_BYTES, BUCKETS, Collection, Conflict, buckets_for

ROW = "key string, n int"


def files_in(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def folders(c):
    return c.manifest()["folders"]


@pytest.fixture
def held(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    c.create(spark.range(10_000).select(F.format_string("d/f%d.go", "id").alias("key"), F.col("id").cast("int").alias("n")), "key")
    return c


def test_one_changed_file_of_ten_thousand_writes_its_bucket_alone(spark, tmp_path, held):
    before, known = files_in(tmp_path), folders(held)
    assert len(known) == BUCKETS
    touched = held.upsert(spark.createDataFrame([("d/f77.go", -1), ("d/f77.go", -2)], ROW))
    after = files_in(tmp_path)
    new = set(after) - set(before)
    assert len(touched) == 1 and len(new) == 1 and f"_bucket={touched[0]}/" in next(iter(new))
    assert {k: t for k, t in after.items() if k in before} == {k: before[k] for k in after if k in before}
    assert {k for k in known if folders(held)[k] != known[k]} == set(touched)
    rows = held.read()
    assert rows.count() == 10_001 and sorted(r["n"] for r in rows.where("key = 'd/f77.go'").collect()) == [-2, -1]
    held.upsert(spark.createDataFrame([], ROW), spark.createDataFrame([("d/f77.go",), ("not there",)], "path string"))
    assert held.read().count() == 9_999


def test_a_lookup_reads_the_buckets_of_its_keys(spark, held):
    keys = spark.createDataFrame([("d/f5.go",), ("d/f6.go",)], "key string")
    got = held.of(keys)
    assert len({f.split("_bucket=")[1].split("/")[0] for f in got.inputFiles()}) == 2 and got.count() < 1_000
    assert got.join(keys, "key").count() == 2


@pytest.mark.parametrize("at", ["change", "write", "commit"])
def test_a_cut_off_change_leaves_the_version_before(spark, monkeypatch, held, at):
    version, rows = held.versions(), Counter(tuple(r) for r in held.read().collect())
    new = spark.createDataFrame([("d/f1.go", 5)], ROW)
    if at == "commit":
        monkeypatch.setattr(held, "_commit", lambda *_: (_ for _ in ()).throw(OSError("cut off")))
    bad = F.raise_error(F.lit("cut off")).cast("int")
    with pytest.raises(Exception, match="cut off"):
        if at == "change":
            held.rewrite(new, lambda old: (_ for _ in ()).throw(OSError("cut off")))
        else:
            held.rewrite(new, lambda old: old.withColumn("n", F.when(F.col("n") % 7 == 0, bad).otherwise(F.col("n")) if at == "write" else F.col("n")))
    monkeypatch.undo()
    assert held.versions() == version and Counter(tuple(r) for r in held.read().collect()) == rows
    held.upsert(new)  # the next change goes on, and clears what was left
    assert held.read().where("n = 5 and key = 'd/f1.go'").count() == 1
    data = held.path.removeprefix("file://") + "/data"
    used = {f.split("/")[0] for v in held.versions() for f in held.manifest(v)["folders"].values()}
    assert set(os.listdir(data)) == used


def test_another_writer_is_noticed(spark, held):
    def change(old):
        Collection(spark, held.path).upsert(spark.createDataFrame([("d/f2.go", 9)], ROW))
        return old

    with pytest.raises(Conflict):
        held.rewrite(spark.createDataFrame([("d/f1.go",)], "key string"), change)
    assert held.read().where("n = 9").count() == 2  # that file's own number 9 and the other writer's


def test_rows_read_before_a_change_stay_readable(spark, held):
    old = held.read()
    held.upsert(spark.createDataFrame([("d/f3.go", -3)], ROW))
    assert old.where("n = -3").count() == 0 and old.count() == 10_000
    assert held.read(held.versions()[-2]).count() == 10_000 and len(held.versions()) == 2


def test_rows_of_other_buckets_are_an_error(spark, held):
    keys = spark.createDataFrame([("d/f1.go",)], "key string")
    with pytest.raises(ValueError, match="which the change didn't name"):
        held.rewrite(keys, lambda old: old.unionByName(spark.createDataFrame([(f"x{i}", i) for i in range(200)], ROW)))
    assert held.read().count() == 10_000


def test_nulls_numbers_and_empty_collections(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/n")
    assert c.read() is None and c.of(spark.range(1)) is None and not c.exists() and c.vacuum() == 0
    with pytest.raises(LookupError):
        c.upsert(spark.createDataFrame([("a", 1)], ROW))
    c.create(spark.createDataFrame([(None, 1), (5, 2), (5, 2)], "key long, n int"), "key", 4)
    c.rewrite(spark.createDataFrame([(None,)], "key int"), lambda old: old.withColumn("n", F.when(F.col("key").isNull(), 7).otherwise(F.col("n"))))
    c.upsert(spark.createDataFrame([(6, 3)], "key long, n int"), spark.createDataFrame([(5,)], "other int"))
    assert sorted(((r["key"] or 0), r["n"]) for r in c.read().collect()) == [(0, 7), (6, 3)]
    c.rebucketed(2)
    assert c.manifest()["buckets"] == 2 and c.read().count() == 2
    c.create(c.read().limit(0), "key")
    assert c.read().count() == 0 and c.read().columns == ["key", "n"] and c.of(spark.range(3)).count() == 0
    assert c.drop() and not c.exists()
    assert buckets_for(0) == BUCKETS and buckets_for(BUCKET_BYTES * 1000) == 1024


def test_a_large_bucket_is_split(spark, tmp_path):
    """Half of all rows have one key: several tasks write them."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        c = Collection(spark, f"file://{tmp_path}/h")
        rows = spark.range(200_000).repartition(8).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"), F.xxhash64("id").alias("n"))
        c.create(rows, "key", 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    per = Counter(f.split("_bucket=")[1].split("/")[0] for f in files_in(tmp_path))
    assert c.read().count() == 200_000 and max(per.values()) > 1


# -- a sync and a build ------------------------------------------------------------------------------


def counted(spark, n, changed=()):
    """(path, content) of n files, and how often contents were made."""
    made = spark.sparkContext.accumulator(0)

    def text(i, new):
        made.add(1)
        return f"func f{i}() {{ {'new' if new else ''} }}\n"

    content = F.udf(text, "string").asNondeterministic()  # so that plans make it where it stands, and once
    ids = spark.range(n).repartition(4)
    return ids.select(F.format_string("d/f%d.go", "id").alias("path"), content("id", F.col("id").isin(list(changed))).alias("content")), made


@pytest.mark.parametrize("most", [syncing.MOST_BROADCAST, 0])
def test_a_sync_reads_its_source_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(syncing, "MOST_BROADCAST", most)
    calls = spark.sparkContext.accumulator(0)
    plain = shaping.hashing_embedder(4)

    def embed(texts):
        calls.add(len(texts))
        return plain(texts)

    rows_path, snap_path = f"file://{tmp_path}/rows", f"file://{tmp_path}/snap"
    source, made = counted(spark, 64)
    syncing.bootstrap(source, embed, rows_path, snap_path, batches=8)
    assert made.value == 64 and calls.value == 64
    before = folders(Collection(spark, rows_path))
    source, made = counted(spark, 63, changed=[5])  # one file is new in content, one is gone
    rows, snap = Collection(spark, rows_path).read(), Collection(spark, snap_path).read()
    out = syncing.sync(source, rows, snap, embed)
    syncing.publish(out, rows_path, snap_path)
    assert made.value == (63 if most else 126) and calls.value == 65  # without a broadcast the changed files are looked up in the source
    assert {r["path"]: r["change"] for r in out.changes.collect()} == {"d/f5.go": "modified", "d/f63.go": "removed"}
    now = folders(Collection(spark, rows_path))
    assert len({k for k in before if now.get(k) != before[k]}) <= 2
    after = {r["relative_path"]: r["content"] for r in Collection(spark, rows_path).read().collect()}
    assert len(after) == 63 and "new" in after["d/f5.go"] and "d/f63.go" not in after
    assert Collection(spark, snap_path).read().count() == 63
    again = syncing.sync(source, Collection(spark, rows_path).read(), Collection(spark, snap_path).read(), embed)
    assert again.changes.isEmpty() and calls.value == 65


def test_calls_change_buckets_alone(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/state", shaping.hashing_embedder(8))
    src, _ = counted(spark, 40)
    s.start_index("/r", src)
    rows = Collection(spark, s._path("rows", "/r"))
    before = folders(rows)
    src, _ = counted(spark, 40, changed=[3])
    assert s.sync_index("/r", src)["files_processed"] == 1
    assert sum(folders(rows)[k] != before[k] for k in before) == 1
    message = lambda c, i: {"conversation_id": c, "message_index": i, "role": "user", "text": f"words {i}", "thinking": None, "tools": None, "timestamp_unix": 1, "workspace_root": "", "archived": None, "parent_conversation_id": "", "load_rules": ""}
    some = {f"c{k}": "1" for k in range(30)}
    s.upsert_conversation_documents_stream("/chats", [("header", {}), ("documents", [message(c, 0) for c in some]), ("manifest", some)])
    rows = Collection(spark, s._path("rows", "/chats"))
    before = folders(rows)
    s.upsert_conversation_documents_stream("/chats", [("header", {}), ("documents", [message("c4", 1)]), ("manifest", {"c4": "2"})])
    assert sum(folders(rows)[k] != before[k] for k in before) == 1 and rows.read().count() == 31
    before = folders(rows)
    s.backfill_conversation_scalars("/chats", [("header", {"dry_run": False}), ("entry", ("c4", "/w", True))])
    assert s.delete_conversation("/chats", "c9") == 1 and s.delete_conversation("/chats", "c9") == 0
    now = folders(rows)
    assert sum(now.get(k) != before[k] for k in before) == 2 and rows.read().where("workspace_root = '/w'").count() == 2
    manifest = json.loads(json.dumps(Collection(spark, s._path("manifests", "/chats")).manifest()["folders"]))
    assert manifest and Collection(spark, s._path("manifests", "/chats")).read().count() == 29
