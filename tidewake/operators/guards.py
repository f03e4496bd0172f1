"""What stops a run before it does harm: budgets, and deletes in waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.status import growth_limit

WAVE_LEAST, WAVE_SHARE, CONFIRMATIONS = 100, 4, 2
MAX_CHUNKS, MAX_BYTES = 200_000, 1 << 30


def tighter(server: int, request: int) -> int:
    """A request can only tighten the server's limit; 0 is none."""
    return request if request > 0 and (server == 0 or request < server) else server


def running_totals(items: DataFrame, seq: str, *columns: str, block: int = 10_000) -> DataFrame:
    """items with total_<column> up to each row in the order of seq (a whole number): sums of blocks before, then within the block, so no task sorts everything."""
    blocked = items.withColumn("_block", F.floor(F.col(seq) / block))
    sums = blocked.groupBy("_block").agg(*[F.sum(c).alias(f"_s_{c}") for c in columns])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block
    sums = sums.select("_block", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_s_{c}") for c in columns])
    within = Window.partitionBy("_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.withColumns({f"_t_{c}": F.sum(c).over(within) for c in columns}).join(sums, "_block")
    return out.select(*items.columns, *[(F.col(f"_t_{c}") + F.col(f"_s_{c}")).alias(f"total_{c}") for c in columns])


def admitted(items: DataFrame, seq: str = "seq", *, expected: int = 0, max_chunks: int = MAX_CHUNKS, max_bytes: int = MAX_BYTES, factor: float = 4.0, floor: int = 10_000) -> DataFrame:
    """items (seq, chunks, bytes) with the totals and, from the first item that breaks a limit, the reason; nothing after it is admitted."""
    limit = growth_limit(F.lit(expected), factor, floor)
    rows = running_totals(items, seq, "chunks", "bytes")
    breach = F.when((F.col("total_chunks") > max_chunks) & F.lit(max_chunks > 0), "chunk_cap").when((F.col("total_bytes") > max_bytes) & F.lit(max_bytes > 0), "byte_cap").when(F.col("total_chunks") > limit, "growth_cap")
    rows = rows.withColumn("breach", breach)
    halt = rows.where("breach is not null").agg(F.min(seq).alias("halt_at"))
    return rows.crossJoin(F.broadcast(halt)).withColumn("admitted", F.col("halt_at").isNull() | (F.col(seq) < F.col("halt_at")))


def sibling_baseline(registry: DataFrame, siblings: DataFrame, own_root: str, config: dict[str, object]) -> DataFrame:
    """(expected): the most chunks that the last successful run of a sibling worktree had, 0 without one; what a first build is expected to have.

    registry: (canonical_path, kind, last_chunks, and the columns of config); siblings: (root). Documents and collections with another model, provider or dimension don't count.
    """
    rows = registry.join(siblings.select(F.col("root").alias("canonical_path")).distinct(), "canonical_path", "left_semi")
    rows = rows.where((F.col("canonical_path") != own_root) & (F.col("kind") != "document") & F.col("last_chunks").isNotNull())
    for name, value in config.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows.agg(F.coalesce(F.max("last_chunks"), F.lit(0)).alias("expected"))


def suspicious(kind: Column, has_run: Column, missing: Column, total: Column) -> Column:
    """A wave of deletes: at least WAVE_LEAST files and a quarter of all, in code that was indexed before."""
    return (kind == "code") & has_run & (total > 0) & (missing >= WAVE_LEAST) & (missing * WAVE_SHARE >= total)


def tracked_total(snapshot_files: Column, last_run_files: Column, live_files: Column) -> Column:
    positive = lambda c: F.when(c > 0, c)
    return F.coalesce(positive(snapshot_files), positive(last_run_files), positive(live_files), F.lit(0))


def watcher_wave(kind: Column, has_run: Column, missing: Column, total: Column, vcs_busy: Column) -> Column:
    """vcs_transient, large_delete or null."""
    return F.when((kind == "code") & (missing >= WAVE_LEAST) & vcs_busy, "vcs_transient").when(suspicious(kind, has_run, missing, total), "large_delete")


def release(root_gone: Column, vcs_busy: Column, still_suspicious: Column, empty_diff: Column, observations: Column) -> Column:
    """What a sweep does with a quarantined codebase; observations: those before this one."""
    return (
        F.when(root_gone, "mark_missing").when(vcs_busy, "hold")
        .when(~still_suspicious, F.when(empty_diff, "clear").otherwise("clear_and_sync"))
        .when(observations + 1 >= CONFIRMATIONS, "sync").otherwise("hold")
    )


def wave(tracked: DataFrame, present: DataFrame, reported: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(missing, total): tracked paths that are gone, of those reported (or all), and how many are tracked."""
    gone = tracked.select(path).join(present.select(path), path, "left_anti")
    if reported is not None:
        gone = gone.join(reported.select(path).distinct(), path, "left_semi")
    return gone.agg(F.count(F.lit(1)).alias("missing")).crossJoin(tracked.agg(F.count(F.lit(1)).alias("total")))


def absence(changes: DataFrame, kind: str, authoritative: bool = False, quarantined: bool = False) -> DataFrame:
    """The changes that may be applied: messages that aren't delivered stay unless the delivery is authoritative; code waits while quarantined."""
    keep = (kind == "document" and not authoritative) or (kind == "code" and quarantined)
    return changes.where(F.col("change") != "removed") if keep else changes
