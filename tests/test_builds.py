"""First builds that are cut off, journals that are compacted, deliveries that are staged, shell commands."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.functions import sizes, vectors
from tidewake.operators import filters, gates, maintenance, reports, retrieval, shaping
from tidewake.plans import sync as syncing
from tidewake.sources import deliveries, files, logs
from tidewake.streaming import events


def test_a_build_goes_on_where_it_was_cut_off(spark, tmp_path):
    src = spark.createDataFrame([(f"d/f{i}.go", f"func f{i}() {{}}\n" * 3) for i in range(40)] + [("x.png", "no")], "path string, content string")
    rows_path, snap_path = f"file://{tmp_path}/rows", f"file://{tmp_path}/snap"
    good = shaping.hashing_embedder(4)

    def bad(texts):
        if any("f7(" in t for t in texts):
            raise ValueError("cut off")
        return good(texts)

    with pytest.raises(Exception, match="cut off"):
        syncing.bootstrap(src, bad, rows_path, snap_path, batches=6)
    assert not (tmp_path / "rows").exists()
    noted = spark.read.parquet(f"{rows_path}_checkpoint")
    before = noted.count()
    assert 0 < before < 40
    (tmp_path / "rows_build" / "batch=torn").mkdir()
    spark.read.parquet(f"{rows_path}_build").drop("batch").limit(3).write.parquet(f"{rows_path}_build/batch=torn2")  # staged, never noted
    changed = noted.orderBy("path").first()["path"]
    now = src.withColumn("content", F.when(F.col("path") == changed, "func other() {}\n").otherwise(F.col("content")))
    built = syncing.bootstrap(now, good, rows_path, snap_path, batches=6)
    assert built.run_mode == "resuming" and built.resumed == before
    rows = built.rows
    assert rows.select("relative_path").distinct().count() == 40 and rows.where("vector is null").isEmpty()
    once = rows.where(F.col("relative_path") != changed).groupBy("relative_path").agg(F.count("*").alias("n"), F.countDistinct("id").alias("m"))
    assert once.where("n != m").isEmpty()
    assert not (tmp_path / "rows_build").exists() and not (tmp_path / "rows_checkpoint").exists()


def test_without_its_stage_a_checkpoint_counts_for_nothing(spark, tmp_path):
    src = spark.createDataFrame([("a.go", "package a\n"), ("b.go", "package b\n")], "path string, content string")
    rows_path, snap_path = f"file://{tmp_path}/rows", f"file://{tmp_path}/snap"
    spark.createDataFrame([("a.go", "old", "b")], "path string, hash string, batch string").write.parquet(f"{rows_path}_checkpoint")
    built = syncing.bootstrap(src, shaping.hashing_embedder(4), rows_path, snap_path, batches=2)
    assert (built.run_mode, built.resumed) == ("first_build", 0) and built.rows.count() == 2 and built.snapshot.count() == 2


def test_a_build_without_rows_is_a_success(spark, tmp_path):
    src = spark.createDataFrame([("a.go", " \n"), ("b.png", "x")], "path string, content string")
    built = syncing.bootstrap(src, shaping.hashing_embedder(4), f"file://{tmp_path}/rows", f"file://{tmp_path}/snap", batches=2)
    assert built.rows is None and not (tmp_path / "rows").exists() and [r["path"] for r in built.snapshot.collect()] == ["a.go"]


def test_sync_takes_vectors_of_the_catalog_first(spark):
    text = "func a() {}\n"
    src = spark.createDataFrame([("a.go", text)], "path string, content string")
    fresh = syncing.chunk_rows(src, 1152, "m")
    own = fresh.withColumn("relative_path", F.lit("old.go")).withColumn("vector", F.array(F.lit(2.0).cast("float")))
    catalog = fresh.select("content_hash", F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    none = spark.createDataFrame([], "path string, hash string")
    vector = lambda **how: syncing.sync(src, own, none, lambda t: [[9.0]] * len(t), model="m", **how).rows.where("relative_path = 'a.go'").first()["vector"]
    assert vector(catalog=catalog) == [1.0] and vector() == [2.0]


def test_journal_is_rewritten_with_what_is_kept(spark, tmp_path):
    job = lambda i, s, m: json.dumps({"event": "x", "occurred_at": f"2024-01-02T00:{m:02}:00Z", "job": {"id": i, "codebase_id": "c", "state": s, "updated_at": f"2024-01-02T00:{m:02}:00Z"}})
    folder = tmp_path / "jobs"
    folder.mkdir()
    (folder / "part.jsonl").write_text("\n".join([job("live", "queued", 1), job("live", "running", 2), *(job(f"j{i}", "failed", 10 + i) for i in range(7)), "torn"]))
    path = f"file://{folder}"
    assert logs.compact(spark, path) == (6, 2)
    kept = logs.job_events(spark, path)
    assert {(r["job_id"], r["state"]) for r in kept.collect()} == {("live", "running"), *((f"j{i}", "failed") for i in range(2, 7))}
    assert logs.compact(spark, path) == (6, 0) and not (tmp_path / "jobs_stg").exists()


def test_chunks_are_kept_and_replaced(spark, tmp_path):
    folder = f"file://{tmp_path}/chunks"
    assert files.cached_chunks(spark, folder, "c") is None
    for n in (3, 2):
        files.cache_chunks(spark.range(n), folder, "c")
        assert files.cached_chunks(spark, folder, "c").count() == n


def test_deliveries_are_staged_batch_by_batch(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    keep = deliveries.staged(spark, path, "conversation_id string, text string")
    parts = [("header", {}), ("documents", [{"conversation_id": "a", "text": "x"}]), ("documents", []), ("documents", [{"conversation_id": "b", "text": None}]), ("manifest", {"a": "f"})]
    got = deliveries.Upsert.read(iter(parts), keep)
    assert got.documents == [] and spark.read.parquet(path).count() == 2
    with pytest.raises(deliveries.OutOfOrder):
        deliveries.Upsert.read(iter([parts[0], parts[1], parts[0]]), lambda batch: None)


def test_tokens_of_shell_commands():
    tokens = shaping.shell_tokens
    assert tokens("X=1 cat a.txt | grep -n 'x y' > ../out/b && ls") == ["cat", "grep", "ls", "/out/b", "../out/b"]
    assert tokens("sort < in.txt >> /var/log/x 2>&1; for i in a; do echo $i > $HOME/f; done") == ["sort", "i", "echo", "/in.txt", "in.txt", "/var/log/x", "$HOME/f"]
    assert tokens("echo 'open") == ["echo 'open"] and tokens("X=1") == ["X=1"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_command_has_tokens(command):
    found = shaping.shell_tokens(command)
    assert len(found) == len(set(found)) and (found or not command.strip())


def test_vectors_of_other_sizes_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(vectors.dot_with(F.col("v"), [1.0, 1.0])).collect()] == [3.0, None]
    for bad in (vectors.dot_with(F.col("v"), [1.0]), vectors.dot(F.col("v"), vectors.literal([1.0] * 3))):
        with pytest.raises(Exception, match="sizes 2 and"):
            df.select(bad).collect()


def test_limits_of_models():
    assert sizes.model_tokens("NVIDIA/nv-embedcode-7b-v1 ") == 4096 and sizes.model_tokens("?") == 512
    assert sizes.model_tokens("embeddinggemma", offline=True) == 2048 and sizes.embed_byte_budget("nvidia/nv-embedcode-7b-v1", 100) == 250


def test_entries_sent_twice_dont_double_rows(spark):
    rows = spark.createDataFrame([("a", "", None), ("a", "/own", None), ("b", "", True)], "conversation_id string, workspace_root string, archived boolean")
    entries = spark.createDataFrame([("a", "/x", True), ("a", "/y", False)], "conversation_id string, workspace_root string, archived boolean")
    assert sorted(tuple(r) for r in maintenance.enriched(rows, entries).collect()) == [("a", "/own", False), ("a", "/y", False), ("b", "", True)]


def test_batches_of_ids_with_slashes(spark):
    rows = spark.createDataFrame([(1, None, "conv/a/b/0"), (2, None, "conv/a/0"), (3, "a", "conv/other/1"), (4, "z", "convtool/a/b/0/1"), (5, None, "conv/a"), (6, None, "x/a/0"), (7, "", "convthink/a/b/c/2")], "n int, conversation_id string, relative_path string")
    ids = spark.createDataFrame([("a",), ("a/b",), ("a",)], "conversation_id string")
    got = {r["n"]: r["batch_id"] for r in filters.of_conversations(rows, ids).collect()}
    assert got == {1: "a/b", 2: "a", 3: "a", 4: "a/b", 7: "a/b"}
    assert filters.in_conversations(rows, ids).columns == rows.columns


def test_ignore_rules_hold_for_events(spark):
    roots = spark.createDataFrame([("c", "/w"), ("d", "/w/sub")], "codebase_id string, root string")
    rows = spark.createDataFrame([(p, False) for p in ("/w/a.go", "/w/sub/b.tmp", "/w/sub/c.min.js", "/w/sub/keep.log")], "path string, is_dir boolean").withColumn("ts", F.current_timestamp())
    own = {"d": gates.rule_set([("*.tmp", "own"), ("!keep.log", "own")])}
    got = {(r["codebase_id"], r["path"]) for r in events.dispatched(rows, roots, own).collect()}
    assert got == {("c", "a.go"), ("c", "sub/b.tmp"), ("d", "keep.log")}


def test_resets_by_a_start(spark):
    t = lambda s: F.to_timestamp(F.lit(f"2024-01-01 {s}"))
    rows = spark.createDataFrame([("a_total", "00:00", 5), ("a_total", "02:00", 9), ("b", "00:00", 5), ("b", "02:00", 1)], "name string, h string, value long")
    rows = rows.select("name", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "h")).alias("at"), "value")
    got = lambda started: {r["name"]: r["reset"] for r in reports.resets(rows, t("01:00"), t("03:00"), started).collect()}
    assert got(None) == got(t("01:00")) == got(t("03:01")) == {"a_total": False, "b": False} and got(t("03:00")) == {"a_total": True, "b": False}
    assert reports.counter_summary(rows.where("name = 'a_total'"), t("01:00"), t("03:00"), t("02:00")).first()["delta"] is None


def test_one_file(spark, tmp_path):
    (tmp_path / "a.go").write_text("func a() {}\n")
    (tmp_path / "big.go").write_text("x" * 50)
    (tmp_path / "bad.go").write_bytes(b"\xff\xfe")
    (tmp_path / "d").mkdir()
    (tmp_path / "x.png").write_bytes(b"1")
    got = {p: files.one(spark, f"file://{tmp_path}", p, 40).first() for p in ("a.go", "big.go", "bad.go", "d", "x.png", "gone.go")}
    assert {p: (r["fate"], r["reason"]) for p, r in got.items()} == {"a.go": ("processed", None), "big.go": ("skipped", "oversize"), "bad.go": ("skipped", "non_utf8"), "d": ("removed", "not_regular"), "x.png": ("removed", "ignored"), "gone.go": ("removed", "absent")}
    assert got["a.go"]["hash"] and got["big.go"]["hash"] is None and got["bad.go"]["content"] is None


def test_totals_of_a_scan(spark):
    src = spark.createDataFrame([("a.go", "func a() {}\n" * 400), ("b.png", "x"), ("c.go", "c")], "path string, content string")
    chunks, totals = syncing.scanned(src)
    n = chunks.count()
    assert {r["reason"]: (r["files"], r["chunks"]) for r in totals.collect()} == {"indexed": (2, n), "ignored": (1, 0)} and n > 2


def test_cells_on_disk(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    middle = rng.normal(size=(6, 16))
    rows = [(i, (middle[i % 6] + 0.2 * rng.normal(size=16)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    centres = retrieval.fitted_centres(df, 6)
    path = f"file://{tmp_path}/cells"
    retrieval.write_cells(df, centres, path)
    assert spark.read.parquet(f"{path}/rows").count() == 600
    hit = 0
    for i in range(0, 600, 50):
        exact = [r["id"] for r in retrieval.search(df, rows[i][1], limit=10).collect()]
        near = retrieval.search_cells(spark, path, rows[i][1], 2, limit=10)
        hit += len(set(exact) & {r["id"] for r in near.collect()})
        assert [r["id"] for r in retrieval.search_cells(spark, path, rows[i][1], 6, limit=10).collect()] == exact
    assert hit >= 0.9 * 120 and "PartitionFilters: [cell" in near._jdf.queryExecution().toString()
