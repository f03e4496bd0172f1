"""The calls by name, on a small codebase and a small collection of conversations."""

import pytest

from tidewake.operators import shaping
from tidewake.operators.filters import ConversationFilter
from tidewake.plans.residency import Residency
from tidewake.service import Service


def message(conversation, index, text, **more):
    return {"conversation_id": conversation, "message_index": index, "role": "User", "text": text, "thinking": None, "tools": None, "timestamp_unix": 100 + index, "workspace_root": "", "archived": None, "parent_conversation_id": "", "load_rules": ""} | more


def test_code_from_index_to_clear(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.go").write_text("func alpha() {}\n")
    (src / "b.py").write_text("def beta(): pass\n")
    s = Service(spark, f"file://{tmp_path}/state", shaping.hashing_embedder(64))
    root = str(src)
    assert s.get_index(root) is None and s.list_jobs() == [] and s.version()["name"] == "tidewake"
    assert s.start_index(root)["mode"] == "bootstrap"
    assert [r["relative_path"] for r in s.search_code(root, "alpha func", extensions=["go"]).collect()] == ["a.go"]
    (src / "c.go").write_text("func gamma() {}\n")
    job = s.start_index(root)
    assert job["mode"] == "incremental" and job["files_processed"] == 1 and job["chunks_processed"] == 3
    assert s.get_index(f"{root}/sub/x.go")["files"] == 3
    assert s.watch_jobs([job["job_id"], "unknown", job["job_id"]])[0]["state"] == "completed" and not s.cancel_job(job["job_id"])
    assert len(s.list_jobs(root)) == 2 and s.get_status() == {"collections": 1, "files": 3, "chunks": 3, "jobs": {"completed": 2}}
    assert s.doctor() == [] and s.shutdown() == (2, 0)
    with pytest.raises(LookupError):
        s.search_code("/elsewhere", "x")
    with pytest.raises(ValueError):
        s.search_code(root, " ")
    assert s.clear_index(root) and s.list_indexes() == [] and not s.clear_index(root)


def test_conversations_from_manifest_to_delete(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/state", shaping.hashing_embedder(64))
    assert s.register_conversation_collection("/chats")["kind"] == "document"
    manifest = {"claude:a": "1", "claude:b": "1"}
    assert s.sync_conversation_manifest("/chats", manifest)[0] == ["claude:a", "claude:b"]
    batch = [message("claude:a", 0, "alpha words"), message("claude:a", 1, "beta words"), message("claude:b", 0, "alpha again", archived=True)]
    s.upsert_conversation_documents_stream("/chats", [("header", {}), ("documents", batch[:1]), ("documents", batch[1:]), ("manifest", manifest)])
    assert s.sync_conversation_manifest("/chats", manifest)[0] == []
    again = [message("claude:a", 0, "edited"), message("claude:a", 2, "gamma words")]
    done = s.upsert_conversation_documents_stream("/chats", [("header", {}), ("documents", again), ("manifest", manifest)])
    assert done["chunks_processed"] == 4  # the edited message stays as it was stored
    found = s.search_conversations("/chats", "alpha words", ConversationFilter(roles=["USER"]), cap=1).collect()
    assert {r["conversation_id"] for r in found} == {"claude:a", "claude:b"} and found[0]["content"] == "alpha words"
    rows, mark = s.search_within_conversation("/chats", "claude:a", "gamma")
    assert rows.count() == 3 and mark == "1"
    entries = [("header", {"dry_run": True}), ("entry", ("claude:a", "/w", False)), ("entry", ("claude:c", "/w", False))]
    assert s.backfill_conversation_scalars("/chats", entries) == {"changed": 3, "orphan": 1}
    entries[0] = ("header", {"dry_run": False})
    s.backfill_conversation_scalars("/chats", entries)
    assert s.search_conversations("/chats", "x", ConversationFilter(workspace_roots=["/w"])).count() == 3
    assert s.delete_conversation("/chats", "claude:a") == 3 and s.sync_conversation_manifest("/chats", manifest)[0] == ["claude:a"]
    with pytest.raises(ValueError):
        s.upsert_conversation_documents_stream("/chats", [("documents", [])])
    assert s.get_status()["jobs"] == {"completed": 2}


def test_graph_tools(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/state", shaping.hashing_embedder(8))
    nodes = spark.createDataFrame([("a", "x/a"), ("b", "x/b"), ("c", "y/c")], "node string, path string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert s.graph_tool("query_graph", {"query": "SELECT count(*) AS n FROM {edges}"}, nodes, edges).first()["n"] == 2
    assert {r["node"] for r in s.graph_tool("trace_path", {"start": ["a"], "depth": 2}, nodes, edges).collect()} == {"a", "b", "c"}
    assert {r["directory"]: r["calls_out"] for r in s.graph_tool("get_architecture", {}, nodes, edges).collect()} == {"x": 2, "y": 0}
    for text in ("one", "two"):
        assert [r["text"] for r in s.graph_tool("manage_adr", {"mode": "update", "name": "n", "section": "s", "text": text}).collect()] == [text]
    assert [r["section"] for r in s.graph_tool("manage_adr", {"mode": "sections", "name": "n"}).collect()] == ["s"]
    with pytest.raises(ValueError):
        s.graph_tool("other", {})


def test_residency(spark):
    now, loads = [0.0], []
    r = Residency(lambda name: loads.append(name) or spark.range(3), idle=10, clock=lambda: now[0])
    with r.lease("a") as rows, r.lease("a"):
        now[0] = 100
        assert rows.count() == 3 and r.state("a") == "ready" and r.sweep() == [] and not r.unload("a")
    assert r.state("a") == "idle" and loads == ["a"]
    now[0] = 109
    assert r.sweep() == []
    now[0] = 110
    assert r.sweep() == ["a"] and r.state("a") == "absent" and not r.unload("a")
    with r.lease("a"):
        pass
    assert loads == ["a", "a"] and r.unload("a")
