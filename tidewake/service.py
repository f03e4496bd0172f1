"""The engine's calls by name, over a folder that holds collections, snapshots, manifests and a job journal.

Each call runs to its end before it returns; what another caller would see meanwhile is in
the journal. Collections, snapshots and manifests lie in buckets of their paths or
conversations: a call writes those that it changes and commits by one small manifest, so a
call that was cut off leaves the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __name__ as PACKAGE
from .functions.keys import canonical_path, collection_name, content_key, metadata_json, provider
from .functions.sizes import embed_byte_budget
from .operators import blocks, graph, maintenance, reports, snapshots
from .operators.filters import ConversationFilter
from .operators.shaping import embedded, message_rows
from .plans import search, sync
from .sources import deliveries, files, logs
from .sources.collections import Collection

VERSION = "2"
MESSAGE = "conversation_id string, message_index int, role string, text string, thinking string, tools array<struct<name:string,display:string,lang_hint:string,output:string,is_error:boolean>>, timestamp_unix bigint, workspace_root string, archived boolean, parent_conversation_id string, load_rules string"
CONVERSATIONS = "id string, conversation_id string, message_index int, role string, relative_path string, content string, content_hash string, provider string, metadata string, timestamp_unix bigint, workspace_root string, archived boolean, parent_conversation_id string, load_rules string, vector array<float>"


class Service:
    """Calls over one folder with one embedder."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[list[str]], list[list[float]]], model: str = ""):
        self.spark, self.folder, self.embed, self.model = spark, folder.rstrip("/"), embed, model

    # -- the folder ---------------------------------------------------------------------------

    def _path(self, kind: str, root: str) -> str:
        return f"{self.folder}/{kind}/{collection_name(root)}"

    def _collection(self, kind: str, root: str) -> Collection:
        return Collection(self.spark, self._path(kind, root))

    def _table(self, kind: str, root: str, schema: str | None = None) -> DataFrame | None:
        rows = self._collection(kind, root).read()
        return self.spark.createDataFrame([], schema) if rows is None and schema else rows

    def _put(self, kind: str, root: str, rows: DataFrame, key: str) -> None:
        """Put rows in place of those with their keys."""
        held = self._collection(kind, root)
        if held.exists():
            held.upsert(rows)
        else:
            held.create(rows, key)

    def _record(self, job: dict[str, Any], state: str, **more: Any) -> dict[str, Any]:
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        job = job | {"state": state, "updated_at": now} | more
        line = json.dumps({"event": state, "occurred_at": now, "job": job})
        self.spark.createDataFrame([(line,)], "line string").coalesce(1).write.mode("append").text(f"{self.folder}/jobs")
        return job

    def _jobs(self) -> DataFrame | None:
        fs_path = f"{self.folder}/jobs"
        try:
            events = logs.job_events(self.spark, fs_path)
        except Exception as e:  # no job was ever started
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return reports.last_events(events.withColumn("order", F.struct("occurred_at", "offset")), "order").drop("order")

    def _run(self, root: str, mode: str, work: Callable[[], dict[str, int]]) -> dict[str, Any]:
        now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        job = self._record({"id": uuid.uuid4().hex, "codebase_id": collection_name(root), "started_at": now}, "running")
        try:
            progress = work()
        except Exception as e:
            self._record(job, "failed", completed_at=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), error=str(e)[:500])
            raise
        done = self._record(job, "completed", completed_at=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"), progress=progress)
        return {"job_id": done["id"], "mode": mode, **progress}

    def _register(self, root: str, kind: str, **fields: Any) -> None:
        schema = "canonical_path string, kind string, collection string, model string, files long, chunks long, updated_at timestamp"
        row = self.spark.createDataFrame([(root, kind, collection_name(root), self.model, fields.get("files"), fields.get("chunks"), datetime.now(UTC))], schema)
        self._put("registry", "/", row, "canonical_path")

    # -- code ---------------------------------------------------------------------------------

    def version(self) -> dict[str, str]:
        return {"name": PACKAGE, "version": VERSION, "spark": self.spark.version}

    def start_index(self, root: str, source: DataFrame | None = None, force: bool = False) -> dict[str, Any]:
        """Index the files below root, from nothing or from what has changed; source: (path, content) instead of what lies on disk."""
        root = canonical_path(root)
        if not force and self._table("rows", root) is not None:
            return self.sync_index(root, source)
        seen = source if source is not None else files.scan(self.spark, root)

        def work() -> dict[str, int]:
            built = sync.bootstrap(seen, self.embed, self._path("rows", root), self._path("snapshots", root), model=self.model, byte_budget=embed_byte_budget(self.model))
            counts = {"files_processed": built.snapshot.count(), "chunks_processed": built.rows.count() if built.rows is not None else 0}
            self._register(root, "code", files=counts["files_processed"], chunks=counts["chunks_processed"])
            return counts

        return self._run(root, "bootstrap", work)

    def sync_index(self, root: str, source: DataFrame | None = None, confirmed: bool = False) -> dict[str, Any]:
        root = canonical_path(root)
        rows = self._table("rows", root)
        if rows is None:
            raise LookupError(f"not indexed: {root}")
        seen = source if source is not None else files.scan(self.spark, root)

        def work() -> dict[str, int]:
            out = sync.sync(seen, rows, self._table("snapshots", root, "path string, hash string"), self.embed, model=self.model, byte_budget=embed_byte_budget(self.model), confirmed=confirmed)
            changed = out.changes.count()
            sync.publish(out, self._path("rows", root), self._path("snapshots", root))
            counts = {"files_processed": changed, "chunks_processed": self._table("rows", root).count()}
            self._register(root, "code", files=self._table("snapshots", root).count(), chunks=counts["chunks_processed"])
            return counts

        return self._run(root, "incremental", work)

    def clear_index(self, root: str) -> bool:
        """Forget a collection, its snapshot and its entry; whether there was one."""
        root = canonical_path(root)
        had = [files.drop(self.spark, self._path(kind, root)) for kind in ("rows", "snapshots", "manifests", "lexical")]
        known = self._collection("registry", "/")
        if known.exists():
            known.rewrite(self.spark.createDataFrame([(root,)], "canonical_path string"), lambda old: old.where(F.col("canonical_path") != root))
        return any(had)

    def list_indexes(self) -> list[dict[str, Any]]:
        known = self._table("registry", "/")
        return [] if known is None else [r.asDict() for r in known.orderBy("canonical_path").collect()]  # a row for each collection

    def get_index(self, path: str) -> dict[str, Any] | None:
        """The entry of the nearest indexed root above a path."""
        path = canonical_path(path)
        found = [x for x in self.list_indexes() if path == x["canonical_path"] or path.startswith(x["canonical_path"].rstrip("/") + "/")]
        return max(found, key=lambda x: len(x["canonical_path"]), default=None)

    def search_code(self, path: str, query: str, *, extensions: Sequence[str] = (), limit: int | None = None, sparse: bool = False) -> DataFrame:
        if not query.strip():
            raise ValueError("a query is required")
        entry = self.get_index(path)
        if entry is None:
            raise LookupError(f"not indexed: {path}")
        root = entry["canonical_path"]
        index = self._keyword_index(root) if sparse else None
        return search.search_code(self._table("rows", root), query, self.embed, root=root, path=canonical_path(path), extensions=extensions, limit=limit, sparse=sparse, index=index)

    def _keyword_index(self, root: str) -> str:
        """The keyword index of a collection's present version, built by the first search that needs it."""
        held, folder = self._collection("rows", root), self._path("lexical", root)
        path = f"{folder}/{held.versions()[-1]}"
        if not files.exists(self.spark, f"{path}/numbers/_SUCCESS"):  # written last
            files.drop(self.spark, folder)
            blocks.write(held.read(), path)
        return path

    def graph_tool(self, tool: str, arguments: dict[str, Any], nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        args = graph.enriched_arguments(tool, arguments, arguments.get("project", ""))
        if tool == "query_graph":
            return graph.query(args["query"], nodes, edges)
        if tool == "trace_path":
            start = self.spark.createDataFrame([(n,) for n in args["start"]], f"node {dict(edges.dtypes)['src']}")
            return graph.trace(edges, start, args.get("direction", "outbound"), args.get("depth", 3))
        if tool == "get_architecture":
            return graph.architecture(nodes, edges, args.get("prefix", ""))
        path = f"{self.folder}/records"
        had = files.recover(self.spark, path) != "none"
        records = graph.Records(self.spark.read.parquet(path) if had else self.spark.createDataFrame([], "name string, section string, text string"))
        if args["mode"] == "update":
            files.replace(records.update(args["name"], args["section"], args["text"]).rows, path)
            records = graph.Records(self.spark.read.parquet(path))
        elif args["mode"] not in ("get", "sections"):
            raise ValueError(f"not a mode: {args['mode']}")
        return records.sections(args["name"]) if args["mode"] == "sections" else records.get(args["name"])

    # -- jobs ---------------------------------------------------------------------------------

    def get_job(self, job_id: str) -> dict[str, Any] | None:
        jobs = self._jobs()
        row = None if jobs is None else jobs.where(F.col("job_id") == job_id).first()
        return row and row.asDict(recursive=True)

    def list_jobs(self, root: str | None = None) -> list[dict[str, Any]]:
        """Jobs that a compaction would keep, the newest first."""
        jobs = self._jobs()
        if jobs is None:
            return []
        kept = reports.retained(jobs if root is None else jobs.where(F.col("codebase_id") == collection_name(canonical_path(root))))
        return [r.asDict(recursive=True) for r in kept.orderBy(F.desc("updated_at"), "job_id").collect()]  # reports.RETAINED rows and those that run

    def watch_jobs(self, ids: Iterable[str]) -> list[dict[str, Any]]:
        """The state of each known job once, in the order asked for."""
        return [job for i in dict.fromkeys(ids) if (job := self.get_job(i)) is not None]

    def cancel_job(self, job_id: str) -> bool:
        """Note a live job as cancelled; one that has ended stays as it is."""
        job = self.get_job(job_id)
        if job is None or job["state"] in reports.TERMINAL:
            return False
        self._record({"id": job_id, "codebase_id": job["codebase_id"]}, "cancelled", completed_at=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ"))
        return True

    # -- conversations ------------------------------------------------------------------------

    def register_conversation_collection(self, name: str) -> dict[str, Any]:
        root = canonical_path(name)
        if self.get_index(root) is None:
            self._register(root, "document", files=0, chunks=0)
        return self.get_index(root) or {}

    def sync_conversation_manifest(self, name: str, manifest: dict[str, str], limit: int = 0, cursor: str = "") -> tuple[list[str], str]:
        """The conversations whose documents are needed, and where to go on."""
        stored = self._table("manifests", canonical_path(name), "conversation_id string, fingerprint string")
        sent = self.spark.createDataFrame(list(manifest.items()), "conversation_id string, fingerprint string")
        keys, following = snapshots.capped_needed(snapshots.needed(stored, sent), limit, cursor)
        return [r[0] for r in keys.collect()], following  # of a manifest that the caller holds

    def upsert_conversation_documents_stream(self, name: str, parts: Iterable[tuple[str, Any]]) -> dict[str, Any]:
        """Add the messages of a delivery that aren't stored; what is stored is never replaced. Documents are staged as they come."""
        root, stage = canonical_path(name), f"{self.folder}/stage/{uuid.uuid4().hex}"
        try:
            got = deliveries.Upsert.read(parts, deliveries.staged(self.spark, stage, MESSAGE))
            return self._run(root, "incremental", lambda: self._ingest(root, stage, got.manifest or {}))
        finally:
            files.drop(self.spark, stage)

    def _ingest(self, root: str, stage: str, manifest: dict[str, str]) -> dict[str, int]:
        stored, empty = self._collection("rows", root), self.spark.createDataFrame([], CONVERSATIONS)
        keys = ["conversation_id", "message_index"]
        extra = ["timestamp_unix", "workspace_root", "archived", "parent_conversation_id", "load_rules"]
        counts = {"files_processed": len(manifest), "chunks_processed": 0}
        if files.recover(self.spark, stage) != "none":
            documents = self.spark.read.schema(MESSAGE).parquet(stage)
            made = message_rows(documents, embed_byte_budget(self.model)).join(documents.select(*keys, *extra).dropDuplicates(keys), keys)
            made = made.withColumns({"content_hash": content_key(F.col("content")), "provider": provider(F.col("conversation_id")), "role": F.lower("role"), "split_part": F.lit(None).cast("int"), "vector": F.lit(None).cast("array<float>")})
            made = made.withColumn("id", F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", "relative_path", "content"), 256), 1, 16)))
            made = made.withColumn("metadata", metadata_json(**{c: F.col(c) for c in [*keys, "role", "timestamp_unix", "workspace_root", "parent_conversation_id", "load_rules"]}))

            def joined(old: DataFrame) -> DataFrame:
                return old.unionByName(embedded(maintenance.missing_families(made, old), self.embed).drop("split_part").select(old.columns))

            if stored.exists():
                stored.rewrite(documents.select("conversation_id"), joined)
            else:
                stored.create(joined(empty), "conversation_id")
            counts["chunks_processed"] = self._table("rows", root).count()
        sent = self.spark.createDataFrame(list(manifest.items()), "conversation_id string, fingerprint string")
        self._put("manifests", root, sent, "conversation_id")
        self._register(root, "document", files=self._table("manifests", root).count(), chunks=counts["chunks_processed"])
        return counts

    def backfill_conversation_scalars(self, name: str, parts: Iterable[tuple[str, Any]]) -> dict[str, int]:
        """Fill in workspace roots and archived flags where rows lack them; (changed, orphan). A dry run only counts."""
        root, got = canonical_path(name), deliveries.Enrichment.read(parts)
        rows = self._table("rows", root, CONVERSATIONS)
        entries = self.spark.createDataFrame(got.entries, "conversation_id string, workspace_root string, archived boolean")
        counts = maintenance.enrichment_counts(rows, entries).first().asDict()
        if not got.dry_run and counts["changed"]:
            self._collection("rows", root).rewrite(entries.select("conversation_id"), lambda old: maintenance.enriched(old, entries).select(old.columns))
        return counts

    def delete_conversation(self, name: str, conversation_id: str) -> int:
        """How many rows went with the conversation."""
        root = canonical_path(name)
        rows, known = self._collection("rows", root), self._collection("manifests", root)
        if not rows.exists():
            return 0
        # its own rows, and by their paths those of conversations whose ids go on below it
        ids = self.spark.createDataFrame([(conversation_id,)], "conversation_id string")
        if known.exists():
            below = known.read().where(F.startswith("conversation_id", F.lit(f"{conversation_id}/")))
            ids = ids.unionByName(below.select("conversation_id"))
        old = rows.of(ids)
        gone = old.count() - maintenance.without_conversation(old, conversation_id).count()
        if gone:
            rows.rewrite(ids, lambda old: maintenance.without_conversation(old, conversation_id))
        if known.exists():
            known.rewrite(ids.limit(1), lambda old: old.where(F.col("conversation_id") != conversation_id))
        return gone

    def search_conversations(self, name: str, query: str, filter: ConversationFilter | None = None, *, cap: int = 0, limit: int | None = None) -> DataFrame:
        return search.search_conversations(self._table("rows", canonical_path(name), CONVERSATIONS), query, self.embed, filter, cap=cap, limit=limit)

    def search_within_conversation(self, name: str, conversation_id: str, query: str, limit: int | None = None) -> tuple[DataFrame, str | None]:
        root = canonical_path(name)
        manifest = self._table("manifests", root, "conversation_id string, fingerprint string")
        return search.search_conversation(self._table("rows", root, CONVERSATIONS), manifest, conversation_id, query, self.embed, limit)

    # -- the whole ----------------------------------------------------------------------------

    def doctor(self) -> list[dict[str, str]]:
        """What is wrong: entries without a collection, and an embedder that doesn't answer."""
        found = []
        for x in self.list_indexes():
            if x["chunks"] and self._table("rows", x["canonical_path"]) is None:
                found.append({"check": "collection", "subject": x["canonical_path"], "problem": "missing"})
        try:
            (vector,) = self.embed(["probe"])
            if not vector:
                raise ValueError("no vector")
        except Exception as e:
            found.append({"check": "embedder", "subject": self.model, "problem": str(e)[:200]})
        return found

    def get_status(self) -> dict[str, Any]:
        """Counts of collections, files, chunks and jobs."""
        entries, jobs = self.list_indexes(), self._jobs()
        states = {} if jobs is None else {r["state"]: r["count"] for r in jobs.groupBy("state").count().collect()}  # a row for each state
        return {"collections": len(entries), "files": sum(x["files"] or 0 for x in entries), "chunks": sum(x["chunks"] or 0 for x in entries), "jobs": states}

    def shutdown(self) -> tuple[int, int]:
        """Compact the job journal; (kept, dropped). The session is its owner's to stop."""
        return (0, 0) if self._jobs() is None else logs.compact(self.spark, f"{self.folder}/jobs")
