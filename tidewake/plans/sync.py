"""A sync of files with their collection, set by set instead of file by file."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import chunk_id, content_key, extension
from ..operators.guards import absence, admitted, suspicious, wave
from ..operators.maintenance import reindexed, run_totals
from ..operators.reuse import reuse
from ..operators.shaping import embedded, file_chunks, split_rows
from ..operators.snapshots import diff
from ..session import staged
from ..sources.collections import Collection, buckets_for
from ..sources.files import drop, gated


@dataclass
class Outcome:
    """What a sync did: rows of the collection and the snapshot after it, the changes it applied, and of these the new rows and (path, hash) entries."""

    rows: DataFrame
    snapshot: DataFrame
    changes: DataFrame
    quarantined: bool
    halted: bool
    new: DataFrame
    entries: DataFrame


def chunk_rows(files: DataFrame, byte_budget: int, model: str = "") -> DataFrame:
    """Rows of a collection without vectors."""
    cut = file_chunks(files).withColumnRenamed("path", "relative_path").withColumn("split_part", F.lit(None).cast("int"))
    rows = split_rows(cut, byte_budget)
    key = chunk_id(F.col("relative_path"), F.col("start_line"), F.col("end_line"), F.col("content"), F.coalesce("split_part", F.lit(0)))
    return rows.select(key.alias("id"), "content", "relative_path", "start_line", "end_line", extension(F.col("relative_path")).alias("file_extension"), "split_part", content_key(F.col("content")).alias("content_hash"), F.lit(model).alias("embedding_model"), F.lit(None).cast("array<float>").alias("vector"))


def scanned(files: DataFrame, byte_budget: int = 1152, model: str = "") -> tuple[DataFrame, DataFrame]:
    """All chunks of files (path, content), without vectors, and the totals of the scan by reason."""
    seen = gated(files)
    kept = seen.where("reason is null").select("path", F.col("content").cast("string").alias("content"))
    chunks = chunk_rows(kept, byte_budget, model)
    return chunks, run_totals(seen, F.col("reason"), chunks)


#: Entries of a snapshot that may be broadcast, counted before: a path and a hash each.
MOST_BROADCAST = 500_000


def read_once(files: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, reason, hash) of every file, and (path, content) of those that may be indexed and aren't in the snapshot with their hash.

    Files are read and hashed in one pass, which keeps the content of the changed ones, as long as the snapshot can be sent to them. Beyond that size contents of changed files are read a second time, so that no content is shuffled.
    """
    kept = F.col("reason").isNull()
    seen = gated(files).select("path", "reason", F.when(kept, F.sha2("content", 256)).alias("hash"), F.when(kept, F.col("content").cast("string")).alias("content"))
    known = snapshot.select("path", F.col("hash").alias("_known"))
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        found = seen.join(F.broadcast(known), "path", "left")
        changed = F.when(~F.col("hash").eqNullSafe(F.col("_known")), F.col("content"))
        rows = staged(found.select("path", "reason", "hash", changed.alias("content")), "scan")
        return rows.select("path", "reason", "hash"), rows.where("content is not null").select("path", "content")
    rows = staged(seen.select("path", "reason", "hash"), "scan")
    touched = rows.where("reason is null").join(known, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_known"))).select("path")
    return rows, files.join(touched, "path", "left_semi").select("path", F.col("content").cast("string").alias("content"))


def sync(files: DataFrame, rows: DataFrame, snapshot: DataFrame, embed: Callable[[list[str]], list[list[float]]], *, catalog: DataFrame | None = None, stores: Sequence[DataFrame] = (), model: str = "", byte_budget: int = 1152, kind: str = "code", confirmed: bool = False, expected_chunks: int = 0) -> Outcome:
    """Bring rows and snapshot in step with files (path, content).

    Vectors come from the catalog, then from the collection's own rows, then from other stores. A suspicious wave of deletes is held back unless confirmed; chunks beyond the budget halt the run before anything is embedded. Files are read once, chunks and vectors made once.
    """
    seen, contents = read_once(files, snapshot)
    current = seen.where("reason is null").select("path", "hash")
    changes = staged(diff(snapshot, current), "changes")
    gone = wave(snapshot, seen).withColumn("held", suspicious(F.lit(kind), F.lit(True), F.col("missing"), F.col("total")))
    quarantined = not confirmed and bool(gone.first()["held"])
    changes = absence(changes, kind, quarantined=quarantined)
    touched = changes.where("change != 'removed'").select("path")
    new = staged(chunk_rows(contents.join(touched, "path", "left_semi"), byte_budget, model), "chunks")
    per_file = new.groupBy("relative_path").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("bytes"))
    # written, as numbers given to rows hold for one run of a plan only
    per_file = staged(per_file.withColumn("seq", F.monotonically_increasing_id()), "files")
    halted = not admitted(per_file, expected=expected_chunks).where("not admitted").isEmpty()
    if halted:
        return Outcome(rows, snapshot, changes.limit(0), quarantined, True, new.limit(0), current.limit(0))
    taken = reuse(new, [*([] if catalog is None else [catalog]), rows, *stores], model).drop("store", "reused").select(new.columns)
    made = staged(embedded(taken, embed), "vectors")
    entries = current.join(touched, "path", "left_semi").select("path", "hash")
    kept = snapshot.join(changes.select("path"), "path", "left_anti").select("path", "hash")
    return Outcome(reindexed(rows, made, changes.select("path")), kept.unionByName(entries), changes, quarantined, False, made, entries)


@dataclass
class Build:
    """What a first build did: its rows and snapshot, how many files earlier attempts had done, and its run mode."""

    rows: DataFrame | None
    snapshot: DataFrame
    resumed: int
    run_mode: str


def bootstrap(files: DataFrame, embed: Callable[[list[str]], list[list[float]]], rows_path: str, snapshot_path: str, *, batches: int = 16, catalog: DataFrame | None = None, stores: Sequence[DataFrame] = (), model: str = "", byte_budget: int = 1152) -> Build:
    """Build a collection from files (path, content) where there is none, in batches that a cut-off run needn't repeat.

    Each batch is written to a stage, then noted with its files and hashes in a checkpoint. The next attempt skips files that the checkpoint has with the same hash, if the stage is still there; what was staged but not noted is not used. Every file counts as added, so rows of a file that went between two attempts stay. At the end the stage takes the place of the collection and the checkpoint that of the snapshot. Without any rows there is no collection, which is a success.
    """
    spark = files.sparkSession
    stage, noted = f"{rows_path}_build", f"{rows_path}_checkpoint"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(rows_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(stage)) or not fs.exists(at(noted)):
        drop(spark, stage), drop(spark, noted)
    snapshot = "path string, hash string, batch string"
    done = spark.read.schema(snapshot).parquet(noted) if fs.exists(at(noted)) else spark.createDataFrame([], snapshot)
    resumed = done.count()
    # the source is read once: what is to be done is written by batch, with its contents
    seen = gated(files).where("reason is null").select("path", F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content"))
    todo = seen.join(done.select("path", "hash"), ["path", "hash"], "left_anti") if resumed else seen
    todo = staged(todo.withColumn("_b", F.pmod(F.xxhash64("path"), F.lit(batches)).cast("int")), "build", "_b")
    seeds = [s for s in (catalog, *stores) if s is not None]
    for k in sorted(r[0] for r in todo.select("_b").distinct().collect()):  # a row for each batch
        part, batch = todo.where(F.col("_b") == k), uuid.uuid4().hex
        new = chunk_rows(part.select("path", "content"), byte_budget, model)
        taken = reuse(new, seeds, model).drop("store", "reused").select(new.columns) if seeds else new
        embedded(taken, embed).write.mode("append").parquet(f"{stage}/batch={batch}")
        part.select("path", "hash").withColumn("batch", F.lit(batch)).coalesce(1).write.mode("append").parquet(noted)
    done = spark.read.schema(snapshot).parquet(noted) if fs.exists(at(noted)) else done
    kept = done.select("path", "hash").distinct()
    rows = None
    if fs.exists(at(stage)):
        rows = spark.read.option("basePath", stage).parquet(stage).join(F.broadcast(done.select("batch").distinct()), "batch", "left_semi").drop("batch")
        if rows.isEmpty():
            rows = None
    if rows is not None:
        collection = Collection(spark, rows_path)
        collection.create(rows, "relative_path", buckets_for(fs.getContentSummary(at(stage)).getLength()))
        rows = collection.read()
    entries = Collection(spark, snapshot_path)
    entries.create(kept, "path")
    drop(spark, stage), drop(spark, noted)
    return Build(rows, entries.read(), resumed, "resuming" if resumed else "first_build")


def publish(outcome: Outcome, rows_path: str, snapshot_path: str) -> None:
    """Put the changes into the stored collection, then into its snapshot, so that a cut-off run is repeated and never skipped; only the buckets of changed paths are written."""
    spark = outcome.rows.sparkSession
    paths = outcome.changes.select("path")
    rows, entries = Collection(spark, rows_path), Collection(spark, snapshot_path)
    if rows.exists():
        rows.rewrite(paths, lambda old: reindexed(old, outcome.new, paths))
    else:
        rows.create(outcome.rows, "relative_path")
    if entries.exists():
        entries.upsert(outcome.entries, paths)
    else:
        entries.create(outcome.snapshot, "path")
