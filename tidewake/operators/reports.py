"""Reports over counters, gauges, spans and jobs of a time window, and views of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_GAP = 15 * 60
STRETCH = 24 * 3600
RETAINED_PER_CODEBASE, RETAINED = 5, 5000
TERMINAL = ("completed", "failed", "cancelled")
PROGRESS = ("files_processed", "files_embedded", "chunks_processed", "chunks_reused", "chunks_embedded", "embedding_batches", "collection_rows_written")
# The known display statuses.
STATUSES = ["indexed", "indexing", "preparing", "pending", "discovered", "quarantined", "stale", "failed", "missing", "waiting", "idle", "loading"]


def counter(name: Column) -> Column:
    return F.endswith(name, F.lit("_total")) | F.endswith(name, F.lit("_sum"))


def seconds(at: Column) -> Column:
    """Seconds since the epoch, with fractions, of a timestamp of either kind."""
    return at.cast("timestamp").cast("double")


def within(at: Column, start: Column, end: Column) -> Column:
    return at.between(start, end)


def baselines(samples: DataFrame, start: Column) -> DataFrame:
    """(name, baseline): the last value at or before the window's start."""
    return samples.where(F.col("at") <= start).groupBy("name").agg(F.max_by("value", "at").alias("baseline"))


def resets(samples: DataFrame, start: Column, end: Column, started: Column | None = None) -> DataFrame:
    """(name, reset): whether a counter fell between the last sample before the window and its end, or its process started in the window (started, a timestamp); what isn't a counter is never reset."""
    fresh = F.lit(False) if started is None else F.coalesce((started > start) & (started <= end), F.lit(False))
    base = samples.where(F.col("at") <= start).groupBy("name").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))
    seen = samples.where(within(F.col("at"), start, end)).select("name", "at", "value").unionByName(base.select("name", "at", "value")).distinct()
    fell = F.col("value") < F.lag("value").over(Window.partitionBy("name").orderBy("at"))
    return seen.withColumn("_fell", fell).groupBy("name").agg((counter(F.col("name")) & (F.coalesce(F.bool_or("_fell"), F.lit(False)) | fresh)).alias("reset"))


def counter_summary(samples: DataFrame, start: Column, end: Column, started: Column | None = None) -> DataFrame:
    """(name, current, delta, rate_per_second): no delta after a reset, without a baseline, or if it would be negative."""
    now = samples.where(F.col("at") <= end).groupBy("name").agg(F.max_by("value", "at").alias("current"))
    rows = now.join(baselines(samples, start), "name", "left").join(resets(samples, start, end, started), "name", "left")
    ok = ~F.coalesce("reset", F.lit(False)) & F.col("baseline").isNotNull() & (F.col("current") >= F.col("baseline"))
    delta = F.when(ok, F.col("current") - F.col("baseline"))
    length = seconds(end) - seconds(start)
    return rows.select("name", "current", delta.alias("delta"), (delta / length).alias("rate_per_second"))


def gauge_summary(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """(name, current, min, mean, max): the live sample counts, if there is another one in the window."""
    inside = within(F.col("at"), start, end)
    kept = F.max(F.when(inside & ~F.col("live"), 1)).isNotNull()
    v = F.when(inside, F.col("value"))
    return samples.groupBy("name").agg(F.max_by("value", F.when(F.col("live"), F.col("at"))).alias("current"), F.when(kept, F.min(v)).alias("min"), F.when(kept, F.avg(v)).alias("mean"), F.when(kept, F.max(v)).alias("max"))


def latency(counters: DataFrame, total: str = "embed_latency_ms_sum", calls: str = "embed_batches_total") -> DataFrame:
    """(total_ms, calls, mean_ms) from the deltas of two counters; no row if either has none."""
    row = counters.agg(F.max(F.when(F.col("name") == total, F.col("delta"))).alias("total_ms"), F.max(F.when(F.col("name") == calls, F.col("delta"))).alias("calls"))
    return row.where("total_ms is not null and calls is not null").withColumn("mean_ms", F.when(F.col("calls") > 0, F.col("total_ms") / F.col("calls")))


def coverage(samples: DataFrame, start: Column, end: Column) -> DataFrame:
    """(first, last, complete): the last sample at or before the start, the last of all, and whether they span the window."""
    out = samples.agg(F.max(F.when(F.col("at") <= start, F.col("at"))).alias("first"), F.max("at").alias("last"))
    return out.withColumn("complete", F.coalesce(F.col("first").isNotNull() & (F.col("last") >= end), F.lit(False)))


def sampling_gap(samples: DataFrame, start: Column, end: Column, key: str | None = None, most: int = MAX_GAP) -> DataFrame:
    """([key,] gap): whether the window, its samples and its end leave over most seconds without a sample.

    Steps are taken within stretches of STRETCH seconds, then between them, so no task sorts all samples.
    """
    keys = [key] if key else []
    times = samples.where(within(F.col("at"), start, end)).select(*keys, "at").distinct().withColumn("_b", F.floor(seconds(F.col("at")) / STRETCH))
    step = seconds(F.col("at")) - seconds(F.lag("at").over(Window.partitionBy(*keys, "_b").orderBy("at")))
    parts = times.withColumn("_s", step).groupBy(*keys, "_b").agg(F.max("_s").alias("_s"), F.min("at").alias("_first"), F.max("at").alias("_last"))
    w = Window.partitionBy(*keys).orderBy("_b") if key else Window.orderBy("_b")  # a row for each stretch
    between = seconds(F.col("_first")) - seconds(F.coalesce(F.lag("_last").over(w), start))
    worst = parts.withColumn("_s", F.greatest("_s", between)).groupBy(*keys).agg(F.max("_s").alias("_s"), F.max("_last").alias("_last"))
    return worst.select(*keys, (F.greatest(F.coalesce("_s", F.lit(0.0)), seconds(end) - seconds(F.coalesce("_last", start))) > most).alias("gap"))


def exclusive(spans: DataFrame) -> DataFrame:
    """spans with exclusive_ms, their own time without that of their children, never below 0, and root, whether their parent is unknown."""
    children = spans.where("parent_span_id is not null").groupBy(F.col("parent_span_id").alias("span_id")).agg(F.sum("duration_ms").alias("_children"))
    known = spans.select(F.col("span_id").alias("parent_span_id"), F.lit(1).alias("_known")).where("parent_span_id is not null").distinct()
    rows = spans.join(children, "span_id", "left").join(known, "parent_span_id", "left")
    own = F.greatest(F.lit(0), F.col("duration_ms") - F.coalesce("_children", F.lit(0)))
    return rows.withColumn("exclusive_ms", own).withColumn("root", F.col("_known").isNull()).drop("_children", "_known")


def durations(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Total, calls, mean, the 50th and 95th percentile (nearest rank) and maximum."""
    pct = lambda f: F.expr(f"percentile_disc({f}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(*keys).agg(F.sum(value).alias("total_ms"), F.count(F.lit(1)).alias("calls"), F.avg(value).alias("mean_ms"), pct(0.5).alias("p50_ms"), pct(0.95).alias("p95_ms"), F.max(value).alias("max_ms"))


def time_breakdown(spans: DataFrame) -> DataFrame:
    return durations(exclusive(spans), "exclusive_ms", "name").orderBy(F.desc("total_ms"), "name")


def unattributed(jobs: DataFrame, spans: DataFrame) -> DataFrame:
    """(job_ms, root_ms, unattributed_ms): job time that no root span explains; null without job time."""
    job = jobs.where("completed_at is not null and started_at is not null").agg(F.sum(F.round((seconds(F.col("completed_at")) - seconds(F.col("started_at"))) * 1000).cast("long")).alias("job_ms"))
    root = exclusive(spans).where("root").agg(F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("root_ms"))
    left = F.when(F.coalesce("job_ms", F.lit(0)) > 0, F.col("job_ms") - F.least("root_ms", "job_ms"))
    return job.crossJoin(root).withColumn("unattributed_ms", left)


def job_rollup(jobs: DataFrame, start: Column, end: Column) -> DataFrame:
    """(name, delta, rate_per_second) over the jobs completed in the window."""
    inside = jobs.where(within(F.col("completed_at"), start, end))
    sums = {f"jobs_{s}": F.count(F.when(F.col("state") == s, 1)) for s in TERMINAL}
    sums |= {p: F.coalesce(F.sum(p), F.lit(0)).cast("long") for p in PROGRESS}
    sums["job_failures"] = F.count(F.when(F.col("state") == "failed", 1))
    wide = inside.agg(*[v.alias(k) for k, v in sums.items()])
    length = seconds(end) - seconds(start)
    tall = wide.unpivot([], list(sums), "name", "delta")
    return tall.select("name", "delta", (F.col("delta") / length).alias("rate_per_second"))


def journal_mismatch(counters: DataFrame, rollup: DataFrame) -> DataFrame:
    """(mismatch): whether a counter saw more jobs end than the journal retains."""
    expected = counters.where(F.col("name").isin([f"jobs_{s}_total" for s in TERMINAL])).select(F.regexp_replace("name", "_total$", "").alias("name"), F.coalesce("delta", F.lit(0)).alias("expected"))
    return expected.join(rollup.select("name", "delta"), "name", "left").agg(F.coalesce(F.bool_or(F.col("expected") > F.coalesce("delta", F.lit(0))), F.lit(False)).alias("mismatch"))


def terminal(state: Column) -> Column:
    return state.isin(*TERMINAL)


def last_events(events: DataFrame, offset: str = "offset") -> DataFrame:
    """The last event of each job, by offset."""
    last = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc(offset)))
    return events.withColumn("_n", last).where("_n = 1").drop("_n")


def job_feed(events: DataFrame, ids: DataFrame, offset: str = "offset") -> DataFrame:
    """The current state, once, of those of the requested jobs (job_id) that are known."""
    return last_events(events.join(ids.select("job_id").distinct(), "job_id", "left_semi"), offset)


def retained(jobs: DataFrame, per_codebase: int = RETAINED_PER_CODEBASE, total: int = RETAINED) -> DataFrame:
    """Jobs that a compaction keeps: all that still run, and the newest terminal ones of each codebase and of all."""
    recency = F.coalesce("completed_at", "updated_at")
    done = jobs.where(terminal(F.col("state"))).withColumn("_at", recency)
    rank = F.row_number().over(Window.partitionBy("codebase_id").orderBy(F.desc("_at"), "job_id"))
    kept = done.withColumn("_n", rank).where(F.col("_n") <= per_codebase).orderBy(F.desc("_at"), "job_id").limit(total)
    return jobs.where(~terminal(F.col("state"))).unionByName(kept.drop("_n", "_at"))


def superseded(jobs: DataFrame) -> DataFrame:
    """Terminal jobs with successor, the next terminal job of their codebase."""
    at = F.coalesce("completed_at", "updated_at")
    return jobs.where(terminal(F.col("state"))).withColumn("successor", F.lead("job_id").over(Window.partitionBy("codebase_id").orderBy(at, "job_id")))


def status_counts(views: DataFrame, statuses: list[str] = STATUSES, status: str = "display") -> DataFrame:
    """(name, value): the total, every known status, also without codebases, then the unknown ones."""
    spark = views.sparkSession
    known = spark.createDataFrame([(s,) for s in statuses], f"{status} string")
    counts = views.groupBy(status).agg(F.count(F.lit(1)).alias("value"))
    named = known.join(counts, status, "full_outer").select(F.concat(F.lit("codebases.status="), F.col(status)).alias("name"), F.coalesce("value", F.lit(0)).alias("value"))
    return views.agg(F.lit("codebases_total").alias("name"), F.count(F.lit(1)).alias("value")).unionByName(named)


def activity(jobs: DataFrame, watcher: DataFrame, pending: DataFrame) -> DataFrame:
    """(running, queued) over jobs and watcher entries by state; what is pending is queued."""
    states = jobs.select("state").unionByName(watcher.select("state")).unionByName(pending.select(F.lit("queued").alias("state")))
    queued = F.count(F.when(F.col("state") == "queued", 1))
    return states.agg((F.count(F.lit(1)) - queued).alias("running"), queued.alias("queued"))


def outcome_rows(c=F.col) -> Column:
    """array<struct<kind, count>> that sums to what was processed; zeros are left out but for embedded."""
    skipped = c("skipped_oversize") + c("skipped_unreadable")
    unchanged = F.greatest(c("processed") - c("embedded") - skipped - c("pending"), F.lit(0))
    every = [("embedded", c("embedded")), ("unchanged", unchanged), ("removed", c("removed")), ("pending", c("pending")), ("oversize", c("skipped_oversize")), ("unreadable", c("skipped_unreadable"))]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("long").alias("count")) for k, v in every])
    return F.filter(rows, lambda x: (x["count"] > 0) | (x["kind"] == "embedded"))


def chunk_rows(added: Column, reused: Column, show_reused: Column) -> Column:
    one = F.array(F.struct(F.lit("added").alias("kind"), added.cast("long").alias("count")))
    return F.when(show_reused, F.concat(one, F.array(F.struct(F.lit("reused").alias("kind"), reused.cast("long").alias("count"))))).otherwise(one)


def overall_percent(chunks_total: Column, chunks_done: Column, run_percent: Column) -> Column:
    """The run's own percent, raised to the share of the corpus that is done where that is known."""
    return F.when(chunks_total > chunks_done, F.greatest(run_percent, chunks_done / chunks_total * 100)).otherwise(run_percent)


def phase_percent(files_total: Column, files_done: Column, batches_total: Column, batches_done: Column) -> Column:
    held = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    return F.when(files_total > 0, held(files_done / files_total * 100)).when(batches_total > 0, held(batches_done / batches_total * 100)).otherwise(0.0)


# The counters of a process. Those in GAUGES go up and down.
COUNTERS = """
embed_batches_total embed_batches_failed embed_vectors_total embed_latency_ms_sum embed_inflight embed_chunks_reused_total embed_inputs_refused_empty
converge_upsert_total converge_remove_total converge_copy_chunks_total sweep_runs_total sweep_changed_total sync_skipped_inflight_total
jobs_completed_total jobs_failed_total jobs_cancelled_total boot_resumes_total jobs_active
milvus_collection_loads_total milvus_collection_load_failures_total milvus_collection_load_wait_timeouts_total milvus_collection_load_inflight milvus_collection_load_latency_ms_sum
milvus_collection_unloads_total milvus_collection_unload_failures_total milvus_collection_unload_skipped_in_use_total milvus_collection_unload_latency_ms_sum
milvus_collection_leases_active milvus_collections_idle milvus_collections_loading milvus_collections_ready milvus_mmap_migrations_total milvus_mmap_migration_failures_total
""".split()
GAUGES = {"embed_inflight", "jobs_active", "milvus_collection_load_inflight", "milvus_collection_leases_active", "milvus_collections_idle", "milvus_collections_loading", "milvus_collections_ready"}


def process_counters(changes: DataFrame) -> DataFrame:
    """(name, value, gauge) of all COUNTERS from their changes (name, delta): sums, so that a gauge is what was entered and not yet left; those without a change are 0."""
    every = changes.sparkSession.createDataFrame([(n, n in GAUGES) for n in COUNTERS], "name string, gauge boolean")
    sums = changes.groupBy("name").agg(F.sum("delta").alias("value"))
    return every.join(sums, "name", "left").select("name", F.coalesce("value", F.lit(0)).cast("long").alias("value"), "gauge")
