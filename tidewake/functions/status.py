"""Decisions over the state of a collection, as ordered cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_status(status: Column, *, active: Column, reconcile: Column, queued: Column, scope_known: Column, degraded: Column, collection: Column) -> Column:
    """What is shown for a codebase: a live job first, then its own status, then what it depends on."""
    base = F.when(active & reconcile, "indexed").when(active & queued, "pending").when(active & scope_known, "indexing").when(active, "preparing")
    for s in ("pending", "discovered", "quarantined", "indexed", "stale", "failed", "missing"):
        base = base.when(status == s, s)
    base = base.otherwise("preparing")
    return (
        F.when(degraded & base.isin("preparing", "indexed"), "waiting")
        .when(~degraded & (base == "indexed") & (collection == "absent"), "missing")
        .when(~degraded & (base == "indexed") & (collection == "idle"), "idle")
        .when(~degraded & (base == "indexed") & collection.isin("building", "loading"), "loading")
        .otherwise(base)
    )


def start_mode(found: Column, status: Column, config_matches: Column, force: Column, presence: Column) -> Column:
    """already, incremental or bootstrap."""
    gone = presence == "missing"
    return (
        F.when(~found, F.when(presence == "present", "incremental").otherwise("bootstrap"))
        .when(status.isin("failed", "stale", "indexing", "missing", "quarantined"), F.when(gone, "bootstrap").otherwise("incremental"))
        .when(status == "indexed", F.when(~force & config_matches & ~gone, "already").when(gone, "bootstrap").otherwise("incremental"))
        .otherwise("bootstrap")
    )


def empty_diff_mode(presence: Column, rows: Column, seed_files: Column) -> Column:
    """bootstrap if the rows are lost, else noop; rows null: unknown."""
    return F.when(presence == "missing", "bootstrap").when((presence == "present") & (rows == 0) & (seed_files > 0), "bootstrap").otherwise("noop")


def search_mode(presence: Column, active: Column, status: Column) -> Column:
    return F.when(presence != "missing", "proceed").when(active | status.isin("stale", "indexing"), "repair").otherwise("missing")


def scope_label(run_mode: Column, unit: Column) -> Column:
    plural = F.concat(unit, F.lit("s"))
    return F.when(run_mode == "bootstrap", F.concat(plural, F.lit(" (full build)"))).when(run_mode == "incremental", F.concat(F.lit("changed "), plural)).otherwise(plural)


def same_model(stored: Column, current: Column) -> Column:
    """An unnamed model goes with any other."""
    stored, current = F.coalesce(stored, F.lit("")), F.coalesce(current, F.lit(""))
    return (stored == "") | (current == "") | (stored == current)


def growth_limit(expected: Column, factor: float = 4.0, floor: int = 10_000) -> Column:
    """The most chunks that a rerun may grow to; null without an expectation, or if neither factor nor floor is above 0."""
    return F.when((expected > 0) & F.lit(factor > 0 or floor > 0), F.greatest(F.ceil(expected * (factor if factor > 0 else 1.0)), expected + floor))


def searchable(eligible: Column, degraded: Column, collection: Column) -> Column:
    """Whether a search is served now: the path is indexed, nothing it depends on is down, and its collection isn't absent, building or unknown; an idle or loading one is loaded by the search."""
    return eligible & ~degraded & ~collection.isin("absent", "building", "unknown")
