"""Operators on small inputs with known results."""

import gzip
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.functions import keys, sizes, status, vectors
from tidewake.operators import filters, gates, graph, guards, lexical, maintenance, paths, reports, retrieval, reuse, shaping, snapshots
from tidewake.plans import search as plans
from tidewake.plans import sync as syncing
from tidewake.sources import deliveries, files, logs
from tidewake.sources.collections import Collection

CODE = "content string, relative_path string, file_extension string, vector array<float>"


# -- search ----------------------------------------------------------------------------------------


def test_code_search_by_extension_and_subtree(spark):
    rows = spark.createDataFrame([("best outside", "other/outside.go", ".go", [1.0, 0.0]), ("best wrong", "scope/wrong.py", ".py", [0.9, 0.1]), ("kept", "scope/kept.go", ".go", [0.8, 0.2])], CODE)
    got = retrieval.search(rows, [1.0, 0.0], where=filters.code_filter(["go"], ["scope"]), id_col="content")
    assert [r["content"] for r in got.collect()] == ["kept"]


CHATS = [("a best", "claude:a", "assistant", 1, 100, [1.0, 0.0]), ("a second", "claude:a", "assistant", 2, 101, [0.9, 0.1]), ("b kept", "claude:b", "assistant", 1, 102, [0.8, 0.2]), ("b too low", "claude:b", "assistant", 2, 103, [0.1, 0.9]), ("filtered", "cursor:c", "user", 1, 104, [0.95, 0.05])]


def chats(spark):
    df = spark.createDataFrame(CHATS, "content string, conversation_id string, role string, message_index int, timestamp_unix long, v array<float>")
    empty = F.lit("")
    return df.select("*", F.col("content").alias("id"), vectors.normalised(F.col("v")).alias("vector"), keys.provider(F.col("conversation_id")).alias("provider"), empty.alias("workspace_root"), empty.alias("parent_conversation_id"), F.lit(None).cast("boolean").alias("archived"))


@pytest.mark.parametrize("many", [False, True])
def test_conversation_search_with_cap_and_floor(spark, many):
    ids = ["claude:a", "claude:b", *(f"claude:x{i}" for i in range(300))] if many else []
    f = filters.ConversationFilter(providers=["claude"], roles=["ASSISTANT"], from_unix=100, until_unix=104, message_index_from=1, conversation_ids=ids, min_score=0.5)
    got = plans.search_conversations(chats(spark), "q", lambda t: [[1.0, 0.0]], f, cap=1)
    assert [r["content"] for r in got.collect()] == ["a best", "b kept"]


def test_archived_null_matches_neither_value(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "n int, archived boolean")
    for value, want in ((True, [1]), (False, [2]), (None, [1, 2, 3])):
        assert [r["n"] for r in rows.where(filters.ConversationFilter(archived=value).predicate()).orderBy("n").collect()] == want


def test_filters_take_any_characters(spark):
    odd = ['a"b', "a\\b", "a_b", "a%b"]
    rows = spark.createDataFrame([(x, x + "/f") for x in odd] + [("axb", "axb/f")], "conversation_id string, p string")
    assert rows.where(filters.ConversationFilter(conversation_ids=odd).predicate()).count() == 4
    assert [r["p"] for r in rows.where(filters.under(F.col("p"), "a_b")).collect()] == ["a_b/f"]
    assert filters.checked_extensions([" go", ".py", ""]) == [".go", ".py"]
    with pytest.raises(ValueError, match="a b"):
        filters.checked_extensions(["a b", "."])


def test_overlaps_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), k, s := rng.randrange(60), s + rng.randrange(25)) for k in range(60)]
    kept = []
    for r in rows:
        if not any(k[0] == r[0] and min(k[3], r[3]) - max(k[2], r[2]) + 1 > 0.5 * (r[3] - r[2] + 1) for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "relative_path string, rank int, start_line int, end_line int")
    assert sorted(tuple(r) for r in retrieval.without_overlaps(df).select("relative_path", "rank", "start_line", "end_line").collect()) == sorted(kept)


def test_search_code_plan(spark):
    embed = shaping.hashing_embedder(16)
    texts = ["alpha beta", "alpha gamma", "delta", "alpha beta gamma"]
    rows = [(f"id{i}", t, f"src/f{i}.go", 1, 3, ".go", embed([t])[0]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, content string, relative_path string, start_line int, end_line int, file_extension string, vector array<float>")
    assert plans.search_code(df, "delta", embed, limit=1).first()["content"] == "delta"
    got = plans.search_code(df, "alpha gamma", embed, path="/src", root="/", extensions=["go"], sparse=True, limit=2).collect()
    assert got[0]["content"] == "alpha gamma" and len(got) == 2
    manifest = spark.createDataFrame([("claude:a", "f1")], "conversation_id string, fingerprint string")
    found, mark = plans.search_conversation(chats(spark), manifest, "claude:a", "q", lambda t: [[1.0, 0.0]])
    assert found.count() == 2 and mark == "f1"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert [round(x, 6) for x in df.select(vectors.normalised(F.col("v"))).first()[0]] == [0.6, 0.8]
    assert df.select(vectors.dot(F.col("v"), vectors.literal([1.0, 1.0]))).first()[0] == 7.0
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vectors.normalised(F.col("v"))).collect()
    pooled = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>").select(vectors.mean_pooled(F.col("t"), F.col("m"))).first()[0]
    assert [round(x, 4) for x in pooled] == [0.7071, 0.7071]


def test_bm25_prefers_rare_terms(spark):
    df = spark.createDataFrame([("a", "common rare"), ("b", "common common"), ("c", "common x y z")], "id string, content string")
    got = {r["id"]: r["score"] for r in lexical.bm25(df, "rare common").collect()}
    assert max(got, key=got.get) == "a" and set(got) == {"a", "b", "c"}


def test_bm25_from_an_index(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    lexical.write_index(docs, f"file://{tmp_path}/index")
    text = "the and ontion, de la"
    found = lexical.bm25_indexed(spark, f"file://{tmp_path}/index", text)
    assert "In(term" in found._jdf.queryExecution().toString()
    rows = lambda df: sorted((r["id"], round(r["score"], 9)) for r in df.collect())
    assert rows(found) == rows(lexical.bm25(docs, text)) and rows(found)


# -- shaping ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80), st.integers(-1, 9))
def test_byte_pieces(text, budget):
    pieces = shaping.byte_pieces(text, budget)
    assert "".join(p for p, _ in pieces) == text
    at = 0
    for p, offset in pieces:
        assert offset == at and (budget <= 0 or len(p.encode()) <= budget or len(p) == 1)
        at += len(p.encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=30).map("\n".join), st.integers(5, 60))
def test_line_windows_cover_the_text(text, size):
    lines = text.splitlines(keepends=True)
    seen = set()
    for content, first, last in shaping.line_windows(text, size, size // 4):
        assert content == "".join(lines[first - 1 : last])
        assert len(content) <= size or first == last
        seen |= set(range(first, last + 1))
    assert seen == set(range(1, len(lines) + 1))


def test_split_rows_records_offsets(spark):
    df = spark.createDataFrame([("x" * 20, None), ("é" * 6, 5), ("short", None)], "content string, split_part int")
    assert sorted((r["split_part"] or 0, r["content"]) for r in shaping.split_rows(df, 10).collect()) == [(0, "short"), (1, "x" * 10), (5, "é" * 5), (11, "x" * 10), (15, "é")]
    assert shaping.split_rows(df, 0).count() == 3


def test_packing_against_a_loop(spark):
    rng = random.Random(1)
    rows = [("k%d" % (i % 3), i, "w" * rng.choice([0, 3, 40, 90, 400])) for i in range(300)]
    got = shaping.packed_by_tokens(spark.createDataFrame(rows, "key string, seq int, content string"), "key", "seq", F.col("seq") % 5 == 0, max_rows=8, tokens=60).collect()
    by = {(r["key"], r["seq"]): r["group"] for r in got}
    for key in ("k0", "k1", "k2"):
        group = used = n = 0
        for k, seq, content in rows:
            if k != key:
                continue
            cost = 0 if seq % 5 == 0 else max(1, (len(content) + 3) // 4)
            if n and (used + cost > 60 or n >= 8):
                group, used, n = group + 1, 0, 0
            used, n = used + cost, n + 1
            assert by[key, seq] == group


def test_embedding_splits_what_is_rejected():
    def embed(texts):
        for i, t in enumerate(texts):
            if len(t) > 4 or t == "!":
                raise shaping.Rejected(i)
        return [[float(len(t))] for t in texts]

    done, dropped = shaping.embed_with_retry(["abcdefghij", " ", "ok", "!"], embed)
    assert [[(p, o) for p, o, _ in x] for x in done] == [[("ab", 0), ("cd", 2), ("e", 4), ("fg", 5), ("hi", 7), ("j", 9)], [], [("ok", 0)], []] and dropped == 1
    with pytest.raises(shaping.Rejected):
        shaping.embed_with_retry(["a", "b"], lambda t: (_ for _ in ()).throw(shaping.Rejected()))


def test_message_rows_and_reassembly(spark):
    doc = [("claude:x", 1, "user", "word " * 40, [{"name": "run", "display": "out " * 40, "lang_hint": "", "output": "", "is_error": False}], "deep thought"), ("claude:x", 2, "assistant", "  ", [], None)]
    df = spark.createDataFrame(doc, "conversation_id string, message_index int, role string, text string, tools array<struct<name:string,display:string,lang_hint:string,output:string,is_error:boolean>>, thinking string")
    rows = shaping.message_rows(df, 64)
    got = {r["relative_path"]: r["content"] for r in rows.collect()}
    assert {p.split("/")[0] for p in got} == {"conv", "convtool", "convthink"} and "convthink/claude:x/1" in got
    assert all(len(c.encode()) <= 64 for c in got.values())
    assert all(c.startswith("run\n") for p, c in got.items() if p.startswith("convtool/"))
    (state,) = shaping.reassembled(rows).collect()
    assert state["text"] == "word " * 40 and state["role"] == "user" and state["has_derived"]


# -- keys, gates, paths ----------------------------------------------------------------------------


def test_paths_of_messages(spark):
    cases = [("conv/a/3", 3, 0), ("conv/a/3/2", 3, 2), ("conv/a/-3", None, None), ("conv/a/3/2/1", None, None), ("convtool/a/3/0", None, None), ("conv/b/3", None, None)]
    df = spark.createDataFrame([(p,) for p, *_ in cases], "p string")
    got = df.select("p", keys.message_index(F.col("p"), F.lit("a")).alias("m"), keys.part_index(F.col("p"), F.lit("a")).alias("n")).collect()
    assert [tuple(r) for r in got] == cases
    assert spark.range(1).select(keys.provider(F.lit("claude:1")), keys.provider(F.lit(":1")), keys.provider(F.lit("x"))).first()[:] == ("claude", "", "")
    assert keys.repair(b"a\xff\xfeb\xffc") == "a�b�c"
    assert spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"a\xff\xfe"),)], "b binary").select(keys.repaired(F.col("b")).alias("t")).collect()[1]["t"] == "a�"


def test_names_and_paths():
    assert keys.collection_name("/x").startswith("code_chunks_") and keys.collection_name("/x", True, "my-repo").startswith("hybrid_code_chunks_my_repo_")
    assert keys.canonical_path("/a/./b/../c/") == "/a/c" and keys.subtree("/a", "/a/b/c") == "b/c" and keys.subtree("/a", "/a") == ""
    for bad in ("", "rel/x", "http://x/y"):
        with pytest.raises(ValueError):
            keys.canonical_path(bad)
    assert keys.config_digest({"a": 1, "ignore_digest": "x"}) == keys.config_digest({"a": 1, "ignore_digest": "y"})
    assert sizes.embed_byte_budget() == 1150 and sizes.backoff_ms(2, 503) == 400 and sizes.backoff_ms(4, 503) is None and sizes.backoff_ms(1, 400) is None
    assert sizes.rejected_input("input[3] has 900 tokens, maximum is 512") == {"index": 3, "limit": 512, "tokens": 900}


def test_ignore_rules():
    rules = gates.rule_set([("build/", "a"), ("!build/keep.txt", "a"), ("*.tmp", "a"), ("!ok.tmp", "a"), ("/top.txt", "a"), ("docs/**/x.md", "a"), ("!important.log", "a")])
    hit = lambda p: gates.excluding_rule(p, rules)
    assert hit("build/keep.txt") == ("build/", "a") and hit("src/a.tmp") == ("*.tmp", "a") and hit("src/ok.tmp") is None
    assert hit("top.txt") and not hit("src/top.txt") and hit("docs/a/b/x.md") and hit("docs/x.md")
    assert hit("a/go.sum") == ("go.sum", "builtin") and hit("a.log") == ("*.log", "builtin") and hit("important.log") is None and hit("main.go") is None


def test_verdicts_and_scope(spark):
    df = spark.createDataFrame([("a/.git/x", 1, True), ("a/x.png", 1, True), ("a/big.go", 9, True), ("a/bin.go", 1, False), ("a/ok.go", 1, True)], "path string, size int, ok boolean")
    got = [r[0] for r in df.select(gates.verdict(F.col("path"), F.col("size"), F.col("ok"), limit=5)).collect()]
    assert got == ["out_of_scope", "ignored", "oversize", "non_utf8", None]
    barred = spark.createDataFrame([("a/.git",)], "root string")
    assert gates.in_scope(df, barred).count() == 4


def test_nearest_root_and_descendants(spark):
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "root string")
    df = spark.createDataFrame([("/a/b/c",), ("/ab/x",), ("/abc",), ("/a",)], "path string")
    assert {tuple(r) for r in paths.nearest(df, roots).collect()} == {("/a/b/c", "/a/b"), ("/ab/x", "/ab"), ("/a", "/a")}
    assert {tuple(r) for r in paths.descendants(roots, roots).collect()} == {("/a", "/a/b")}


# -- snapshots, reuse, maintenance -----------------------------------------------------------------


@pytest.mark.parametrize("before,after,want", [({}, {}, {}), ({"a": "1"}, {"a": "1"}, {}), ({}, {"a": "1"}, {"a": "added"}), ({"a": "1"}, {"a": "2"}, {"a": "modified"}), ({"a": "1"}, {}, {"a": "removed"}), ({"a": "1", "b": "1", "c": "1"}, {"b": "2", "c": "1", "d": "1"}, {"a": "removed", "b": "modified", "d": "added"})])
def test_diff(spark, before, after, want):
    make = lambda d: spark.createDataFrame(list(d.items()), "path string, hash string")
    assert {r["path"]: r["change"] for r in snapshots.diff(make(before), make(after)).collect()} == want
    assert snapshots.equal(make(before), make(after)) == (not want)


def test_capped_needed(spark):
    make = lambda a, m: spark.createDataFrame([(x, "added") for x in a] + [(x, "modified") for x in m], "conversation_id string, change string")
    ask = lambda a, m, n, c="": (lambda t: ([r[0] for r in t[0].collect()], t[1]))(snapshots.capped_needed(make(a, m), n, c))
    assert ask("ab", "cd", 0, "x") == (["a", "b", "c", "d"], "x")
    assert ask("abcd", "", 2) == (["a", "b"], "b") and ask("abcd", "", 2, "c") == (["a", "d"], "a")
    assert ask("ab", "cde", 2, "c") == (["d", "e"], "e") and ask("ab", "cde", 2, "e") == (["c", "d"], "d")
    assert ask("ab", "cd", 3, "a") == (["b", "c", "d"], "b") and ask("", "cd", 2) == (["c", "d"], "d")


def test_fingerprint_covers_tools_and_thinking(spark):
    import hashlib

    schema = "conversation_id string, message_index int, role string, text string, tools array<struct<name:string,display:string,lang_hint:string,output:string,is_error:boolean>>, thinking string"
    tool = {"name": "n", "display": "d", "lang_hint": "l", "output": "o", "is_error": True}
    df = spark.createDataFrame([(" c ", 2, "user", "b", [], None), ("c", 1, "user", "a", [tool], "t"), (" ", 1, "user", "x", [], "")], schema)
    body = b"1\0user\0a\0n\0d\0l\0o\0true\0t\0" + b"2\0user\0b\0\0"
    assert [tuple(r) for r in snapshots.fingerprints(df).collect()] == [("c", hashlib.sha256(body).hexdigest())]


def test_reuse_needs_equal_content_and_model(spark):
    store = lambda rows: spark.createDataFrame(rows, "content_hash string, content string, embedding_model string, vector array<float>")
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "content string")
    first = store([(None, "a", "old", [1.0]), (None, "a", "", [2.0]), (None, "a", "m", [3.0])])
    second = store([(None, "b", None, [4.0]), ("0", "c", "m", [5.0])])
    got = {r["content"]: (r["vector"], r["reused"]) for r in reuse.reuse(chunks, [first, second], "m").collect()}
    assert got == {"a": ([3.0], True), "b": ([4.0], True), "c": (None, False)}
    known = spark.createDataFrame([(1, "x")], "label int, v string")
    assert reuse.looked_up(known.select("label"), known).count() == 1
    with pytest.raises(Exception, match="unknown label"):
        reuse.looked_up(spark.createDataFrame([(2,)], "label int"), known).collect()


def test_pruning_and_backfill(spark):
    rows = spark.createDataFrame([("conv/a/1", "a"), ("conv/b/1", "b"), ("convtool/a/1/0", "a"), ("conv/ab/1", "c")], "relative_path string, content string")
    assert maintenance.pruned(rows, rows.limit(0)).count() == 4
    assert {r[0] for r in maintenance.without_conversation(rows, "a").select("relative_path").collect()} == {"conv/b/1", "conv/ab/1"}
    old = spark.createDataFrame([('{"conversation_id":"claude:1","role":"USER","message_index":2}', None, "x", None, None, None, None, None)], "metadata string, conversation_id string, role string, provider string, parent_conversation_id string, message_index int, timestamp_unix long, load_rules string")
    assert maintenance.backfilled(old).select("conversation_id", "role", "provider", "message_index").first()[:] == ("claude:1", "user", "claude", 2)
    registry = spark.createDataFrame([("/a",), ("/a/b",), ("/ab",)], "canonical_path string")
    assert {r[0] for r in maintenance.absorbed(registry, "/a").collect()} == {"/a", "/ab"}


# -- guards ----------------------------------------------------------------------------------------


def test_waves_and_absence(spark):
    case = lambda m, t, kind="code", ran=True: spark.range(1).select(guards.suspicious(F.lit(kind), F.lit(ran), F.lit(m), F.lit(t))).first()[0]
    assert case(100, 400) and not case(99, 100) and not case(100, 401) and not case(100, 400, "document") and not case(100, 400, ran=False)
    busy = spark.range(1).select(guards.watcher_wave(F.lit("code"), F.lit(True), F.lit(100), F.lit(9999), F.lit(True))).first()[0]
    assert busy == "vcs_transient"
    changes = spark.createDataFrame([("a", "removed"), ("b", "added")], "path string, change string")
    assert guards.absence(changes, "document").count() == 1 and guards.absence(changes, "document", authoritative=True).count() == 2 and guards.absence(changes, "code", quarantined=True).count() == 1
    assert guards.tighter(10, 0) == 10 and guards.tighter(10, 20) == 10 and guards.tighter(0, 5) == 5


def test_admission_across_blocks(spark):
    df = spark.createDataFrame([(i, 1, 10) for i in range(0, 50_000, 7)], "seq long, chunks long, bytes long")
    got = guards.admitted(df, max_chunks=5_000, max_bytes=0).agg(F.count(F.when(F.col("admitted"), 1)), F.max("total_chunks"), F.first("halt_at")).first()
    assert tuple(got) == (5_000, 7_143, 35_000)


def test_status_folds(spark):
    f, t = F.lit(False), F.lit(True)
    shown = lambda s, active=f, degraded=f, collection="ready", **k: spark.range(1).select(status.display_status(F.lit(s), active=active, reconcile=k.get("reconcile", f), queued=k.get("queued", f), scope_known=k.get("scope", f), degraded=degraded, collection=F.lit(collection))).first()[0]
    assert shown("indexed") == "indexed" and shown("indexed", degraded=t) == "waiting" and shown("indexed", collection="absent") == "missing"
    assert shown("stale", degraded=t) == "stale" and shown("failed", active=t, queued=t) == "pending" and shown("failed", active=t) == "preparing" and shown("indexing") == "preparing" and shown("indexed", active=t, scope=t, degraded=t) == "indexing"


# -- reports ---------------------------------------------------------------------------------------


def test_report_over_log_files(spark, tmp_path):
    at = lambda m: f"2026-07-31T{13 + m // 60:02d}:{m % 60:02d}:00Z"
    sample = lambda m, v, j: json.dumps({"time": at(m), "msg": "daemon.perf_counters", "vectors_total": v, "jobs_active": j})
    span = lambda i, p, d: json.dumps({"time": at(30), "msg": "daemon.span.completed", "span": i, "span_id": i, "parent_span_id": p, "job_id": "j", "duration_ms": d})
    (tmp_path / "a.jsonl").write_text("\n".join([sample(-10, 10, 1), sample(20, 14, 3), "{torn", span("root", "", 100)]) + "\n")
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(span("child", "root", 40) + "\n")
    read = logs.lines(spark, str(tmp_path))
    assert logs.malformed(read).first()["malformed"] == 1
    start, end = F.to_timestamp(F.lit("2026-07-31T13:00:00Z")), F.to_timestamp(F.lit("2026-07-31T14:00:00Z"))
    live = spark.createDataFrame([("vectors_total", 15), ("jobs_active", 2)], "name string, value long").select(end.alias("at"), "name", "value", F.lit(True).alias("live"))
    samples = logs.samples(read).unionByName(live)
    counters = {r["name"]: r for r in reports.counter_summary(samples.where(reports.counter(F.col("name"))), start, end).collect()}
    assert counters["vectors_total"]["delta"] == 5 and abs(counters["vectors_total"]["rate_per_second"] - 5 / 3600) < 1e-12
    gauge = {r["name"]: r for r in reports.gauge_summary(samples, start, end).collect()}["jobs_active"]
    assert (gauge["current"], gauge["min"], gauge["max"]) == (2, 2, 3)
    spans = logs.spans(read)
    assert {r["name"]: r["exclusive_ms"] for r in reports.exclusive(spans).collect()} == {"root": 60, "child": 40}
    jobs = spark.createDataFrame([(0.2,)], "d double").select(start.alias("started_at"), (start + F.expr("INTERVAL 0.2 SECOND")).alias("completed_at"))
    assert reports.unattributed(jobs, spans).first()["unattributed_ms"] == 100
    assert reports.sampling_gap(samples, start, end).first()["gap"] and reports.coverage(samples, start, end).first()["complete"]
    assert [r["name"] for r in reports.time_breakdown(spans).collect()] == ["root", "child"]


def test_resets_hide_deltas(spark):
    rows = [("x_total", 0, 5), ("x_total", 20, 9), ("x_total", 40, 2), ("x_total", 50, 20)]
    df = spark.createDataFrame(rows, "name string, m int, value long").select("name", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins="m")).alias("at"), "value", F.lit(False).alias("live"))
    start, end = F.lit("2024-01-01 00:10:00").cast("timestamp"), F.lit("2024-01-01 01:00:00").cast("timestamp")
    assert reports.counter_summary(df, start, end).first()["delta"] is None
    assert reports.counter_summary(df.where("m < 30"), start, end).first()["delta"] == 4


def test_journal(spark, tmp_path):
    job = lambda i, s, u: json.dumps({"event": "x", "occurred_at": u, "job": {"id": i, "codebase_id": "c", "state": s, "started_at": u, "completed_at": None, "updated_at": u, "progress": {"files_processed": 2}}})
    p = tmp_path / "jobs.jsonl"
    p.write_text("\n".join([job("a", "running", "2024-01-01T00:00:00Z"), job("a", "completed", "2024-01-01T00:01:00Z"), "nonsense", *(job(f"j{i}", "failed", f"2024-01-02T00:0{i}:00Z") for i in range(7))]))
    last = reports.last_events(logs.job_events(spark, str(p)))
    assert last.count() == 8
    assert {r["job_id"] for r in reports.retained(last).collect()} == {f"j{i}" for i in range(2, 7)}
    assert {r["job_id"]: r["successor"] for r in reports.superseded(last).collect()}["a"] == "j0"
    with pytest.raises(Exception, match="malformed"):
        logs.job_events(spark, str(p), strict=True).collect()
    q = tmp_path / "rows.jsonl"
    q.write_text('{"id":"a"}\n{"id":"b"}\n{"id":')
    rows, healed = logs.collection_rows(spark, str(q), "id string")
    assert healed and rows.count() == 2


# -- graphs and deliveries -------------------------------------------------------------------------


def test_traces(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b")], "src string, dst string")
    start = spark.createDataFrame([("b",)], "node string")
    got = lambda d, n: {tuple(r) for r in graph.trace(edges, start, d, n).collect()}
    assert got("outbound", 2) == {("b", 0), ("c", 1), ("a", 2)} and got("inbound", 1) == {("b", 0), ("a", 1), ("d", 1)}
    assert got("both", 5) == {("b", 0), ("a", 1), ("c", 1), ("d", 1)}
    with pytest.raises(ValueError):
        graph.trace(edges, start, "up")
    records = graph.Records(spark.createDataFrame([], "name string, section string, text string")).update("n", "s", "1").update("n", "s", "2")
    assert [r["text"] for r in records.get("n").collect()] == ["2"] and records.sections("n").count() == 1
    assert graph.enriched_arguments("trace_path", {"a": 1}, "p") == {"a": 1, "project": "p"}


def test_deliveries_come_in_order():
    got = deliveries.Upsert.read([("header", {}), ("documents", [{"a": 1}]), ("documents", [{"b": 1}]), ("manifest", {"x": "y"})])
    assert len(got.documents) == 2
    for bad in ([("documents", [])], [("header", {}), ("header", {})], [("header", {})], [("header", {}), ("manifest", {}), ("documents", [])]):
        with pytest.raises(deliveries.OutOfOrder):
            deliveries.Upsert.read(bad)
    assert deliveries.Enrichment.read([("header", {"dry_run": True}), ("entry", ("c", "/r", True))]).dry_run


# -- a whole sync ----------------------------------------------------------------------------------


def test_sync_round_trip(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    (src / "a.go").write_text("func a() {}\n" * 300)
    (src / "sub/b.go").write_text("func b() {}\n")
    (src / "x.png").write_bytes(b"\x89PNG\xff")
    embed = shaping.hashing_embedder(8)

    read = lambda: files.scan(spark, str(src))
    assert {r["path"] for r in read().collect()} == {"a.go", "sub/b.go", "x.png"}
    schema = syncing.chunk_rows(spark.createDataFrame([], "path string, content string"), 100).schema
    empty, none = spark.createDataFrame([], schema), spark.createDataFrame([], "path string, hash string")
    out = syncing.sync(read(), empty, none, embed)
    rows_path, snap_path = f"file://{tmp_path}/rows", f"file://{tmp_path}/snap"
    syncing.publish(out, rows_path, snap_path)
    rows, snap = Collection(spark, rows_path).read(), Collection(spark, snap_path).read()
    first = {r["id"]: r["vector"] for r in rows.collect()}
    assert snap.count() == 2 and all(v for v in first.values()) and rows.where("relative_path = 'sub/b.go'").count() == 1
    (src / "sub/b.go").unlink()
    (src / "c.go").write_text("func c() {}\n")
    out = syncing.sync(read(), rows, snap, embed)
    syncing.publish(out, rows_path, snap_path)
    rows = Collection(spark, rows_path).read()
    assert {r["relative_path"] for r in rows.select("relative_path").distinct().collect()} == {"a.go", "c.go"}
    assert {r["path"] for r in Collection(spark, snap_path).read().collect()} == {"a.go", "c.go"}
    assert files.recover(spark, rows_path) == "kept" and files.append(rows, f"file://{tmp_path}/more") == rows.count() and files.drop(spark, f"file://{tmp_path}/more")


def test_pieces_by_bytes_as_in_python_without_leaving_the_jvm(spark, capsys):
    texts = [None, "", "a", "abc" * 700, "é x " * 60, "aé漢𝄞" * 9, "𝄞" * 3, "漢字" * 900]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (0, 1, 2, 3, 4, 5, 7, 100)], "t string, n int")
    cut = rows.select("t", "n", shaping.split_bytes(F.col("t"), F.col("n")).alias("p"))
    for r in cut.collect():
        assert (r["p"] and [tuple(x) for x in r["p"]]) == (None if r["t"] is None else shaping.byte_pieces(r["t"], r["n"]))
    cut.explain()
    assert "Python" not in capsys.readouterr().out


def test_only_shell_commands_leave_the_jvm(spark, capsys):
    call = "array<struct<name:string,display:string,lang_hint:string,output:string,is_error:boolean>>"
    rows = spark.createDataFrame([("c:1", k, "user", f"text {k}", [("run", "cat x > y", hint, "", False)]) for k, hint in enumerate(["bash", "sql", None])], f"conversation_id string, message_index int, role string, text string, tools {call}")
    got = shaping.message_rows(rows, 1_000)
    found = {(r["relative_path"], r["content"]) for r in got.collect()}
    assert {c for p, c in found if p.startswith("convtool/")} == {"run\ncat\n/y\ny\ncat x > y", "run\ncat x > y"}
    assert len(found) == 6
    got.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") <= 2  # of shell calls, in their filter and their pieces


def test_pooling_computes_masked_vectors_and_their_length_once(spark, capsys):
    rows = spark.createDataFrame([([[3.0, 4.0], [5.0, 12.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<float>>, m array<int>")
    got = rows.select(vectors.mean_pooled(F.col("t"), F.col("m")).alias("v"))
    assert got.first()["v"] == pytest.approx([4 / 80**0.5, 8 / 80**0.5])
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("zip_with(t") == 1 and plan.count("SQRT") == 1
