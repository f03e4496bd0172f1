"""Changes to the rows of a collection, as the new rows of the collection."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import chunk_id, family_path, metadata_of, moved_id, provider
from ..schemas import METADATA
from .filters import needs_enrichment, under


def removed(rows: DataFrame, paths: DataFrame | None = None, prefixes: Sequence[str] = (), path: str = "relative_path") -> DataFrame:
    """rows without those of the paths, or below the prefixes."""
    if paths is not None:
        rows = rows.join(paths.select(F.col(paths.columns[0]).alias(path)).distinct(), path, "left_anti")
    hits = [c for p in prefixes if (c := under(F.col(path), p)) is not None]
    return rows.where(~reduce(or_, hits)) if hits else rows


def replaced(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """rows with those of equal key displaced by new ones."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def reindexed(rows: DataFrame, new: DataFrame, paths: DataFrame | None = None, prefixes: Sequence[str] = ()) -> DataFrame:
    return replaced(removed(rows, paths, prefixes), new)


def pruned(rows: DataFrame, current: DataFrame, path: str = "relative_path") -> DataFrame:
    """rows of current paths only; an empty list of current paths changes nothing."""
    keys = current.select(F.col(current.columns[0]).alias(path)).distinct()
    return rows if keys.isEmpty() else rows.join(keys, path, "left_semi")


def missing_families(produced: DataFrame, stored: DataFrame, path: str = "relative_path") -> DataFrame:
    """Produced rows whose message, tool output or thinking has no stored row; what is stored is never replaced."""
    have = stored.select(family_path(F.col(path)).alias("_family")).distinct()
    return produced.withColumn("_family", family_path(F.col(path))).join(have, "_family", "left_anti").drop("_family")


def needs_work(expected: DataFrame, stored: DataFrame, key: str = "conversation_id") -> DataFrame:
    """The conversations of which an expected path (key, relative_path) isn't stored with content."""
    usable = stored.where(F.regexp_like("content", F.lit(r"(?U)\S"))).select(family_path(F.col("relative_path")).alias("relative_path")).distinct()
    return expected.join(usable, "relative_path", "left_anti").select(key).distinct()


def enriched(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows with workspace root and archived filled in where they lack them; of several entries of a conversation the one with the greatest root, then archived, counts."""
    one = F.max(F.struct(F.coalesce("workspace_root", F.lit("")).alias("root"), "archived"))
    new = entries.groupBy("conversation_id").agg(one.alias("_e")).select("conversation_id", F.col("_e.root").alias("_root"), F.col("_e.archived").alias("_archived"), F.lit(True).alias("_in"))
    joined = rows.join(new, "conversation_id", "left")
    target = F.coalesce(F.col("_in"), F.lit(False)) & needs_enrichment(F.col("workspace_root"), F.col("archived"))
    root = F.when(target, F.coalesce(F.when(F.col("workspace_root") != "", F.col("workspace_root")), F.col("_root"))).otherwise(F.col("workspace_root"))
    archived = F.when(target, F.coalesce("archived", "_archived")).otherwise(F.col("archived"))
    return joined.withColumn("workspace_root", root).withColumn("archived", archived).drop("_root", "_archived", "_in")


def enrichment_counts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(changed, orphan): rows that would be filled in, and rows that would if there were an entry for them."""
    target = rows.where(needs_enrichment(F.col("workspace_root"), F.col("archived")))
    joined = target.join(entries.select("conversation_id", F.lit(1).alias("_in")).distinct(), "conversation_id", "left")
    return joined.agg(F.count("_in").alias("changed"), F.count(F.when(F.col("_in").isNull(), 1)).alias("orphan"))


def backfilled(rows: DataFrame) -> DataFrame:
    """The message columns taken again from the metadata, if any row lacks its provider; workspace root and archived stay."""
    if rows.where("provider is null").isEmpty():
        return rows
    read = rows.withColumn("_m", metadata_of(F.col("metadata"), METADATA))
    for c in ("conversation_id", "parent_conversation_id", "message_index", "timestamp_unix", "load_rules"):
        read = read.withColumn(c, F.col(f"_m.{c}"))
    return read.withColumn("role", F.lower("_m.role")).withColumn("provider", provider(F.coalesce("_m.conversation_id", F.lit("")))).drop("_m")


def copied(rows: DataFrame, source: str, target: str, move: bool = False) -> DataFrame:
    """rows with those of one file also (or, moved, only) at another path, vectors and all, under new ids."""
    at = F.col("relative_path") == source
    new_id = F.when(F.col("split_part") > 0, chunk_id(F.lit(target), F.col("start_line"), F.col("end_line"), F.col("content"), F.col("split_part"))).otherwise(moved_id(F.lit(target), F.col("id")))
    copies = rows.where(at).withColumn("id", new_id).withColumn("relative_path", F.lit(target))
    return replaced(rows.where(~at) if move else rows, copies)


def without_conversation(rows: DataFrame, conversation_id: str) -> DataFrame:
    return removed(rows, prefixes=[f"{k}/{conversation_id}" for k in ("conv", "convtool", "convthink")])


def absorbed(registry: DataFrame, root: str, path: str = "canonical_path") -> DataFrame:
    """The registry without the codebases below root; their collections stay."""
    return registry.where(~F.startswith(F.col(path), F.lit(root.rstrip("/") + "/")))


def run_totals(files: DataFrame, reason: Column, chunks: DataFrame | None = None) -> DataFrame:
    """(reason, files, bytes) of a run's files, the indexed ones under the reason 'indexed'; with chunks (a row for each) also how many there are and their bytes, which are the indexed files'."""
    out = files.groupBy(F.coalesce(reason, F.lit("indexed")).alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
    if chunks is None:
        return out
    zero = F.lit(0).cast("long")
    made = chunks.agg(F.lit("indexed").alias("reason"), F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("content")).alias("chunk_bytes"))
    joined = out.join(F.broadcast(made), "reason", "full_outer")  # one row
    return joined.select("reason", *[F.coalesce(c, zero).alias(c) for c in ("files", "bytes", "chunks", "chunk_bytes")])
