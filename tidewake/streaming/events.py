"""File events as a stream: coalesced while they keep coming, dispatched to roots, converged in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.gates import extension_regex, ignored
from ..operators.paths import ancestors
from ..operators.snapshots import converge

DEBOUNCE = "2 seconds"
EVENTS = "ts timestamp, path string, is_dir boolean"


def read(spark: SparkSession, path: str, schema: str = EVENTS, format: str = "json", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def dispatched(events: DataFrame, roots: DataFrame, rules: dict[str, tuple[tuple[str, str], ...]] | None = None) -> DataFrame:
    """(ts, codebase_id, path) of file events, relative to each root (codebase_id, root) that covers them; directories, what lies in .git and what a codebase's ignore rules exclude go.

    rules: the rule set of each codebase that has its own; the built-in rules hold for the others.
    """
    kept = events.where(~F.col("is_dir") & ~F.array_contains(F.split("path", "/"), ".git"))
    up = kept.select("ts", "path", F.explode(ancestors(F.col("path"))).alias("root"))
    found = up.join(roots.select("codebase_id", "root"), "root").where(F.col("root") != F.col("path"))
    found = found.select("ts", "codebase_id", F.substr("path", F.length("root") + 2, F.length("path")).alias("path"))
    own = rules or {}
    builtin = F.coalesce(F.regexp_like("path", F.lit(extension_regex())), F.lit(False))
    hit = F.lit(None).cast("boolean")
    for codebase, lines in own.items():
        hit = F.coalesce(hit, F.when(F.col("codebase_id") == codebase, ignored(F.col("path"), lines)["pattern"].isNotNull()))
    return found.where(~F.coalesce(hit, builtin))


def debounced(events: DataFrame, gap: str = DEBOUNCE, delay: str | None = "10 seconds") -> DataFrame:
    """(codebase_id, start, end, paths, events): one row for each burst that a quiet gap ends. On a stream, events later than delay are left out: a later sweep finds what they changed."""
    rows = events.withWatermark("ts", delay) if delay and events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "codebase_id").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count(F.lit(1)).alias("events"))
    return out.select("codebase_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "paths", "events")


def deferred(events: DataFrame) -> DataFrame:
    """(codebase_id, paths): paths that come while a job is live wait until it ends.

    events: (codebase_id, path, kind) with kind start, end or path; on a path without a live job it is passed on at once.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, waiting = state.get if state.exists else (False, [])
        waiting, ready = list(waiting), []
        for pdf in batches:
            for path, kind in zip(pdf["path"], pdf["kind"]):
                if kind == "start":
                    live = True
                elif kind == "end":
                    live = False
                    ready += waiting
                    waiting = []
                elif live:
                    waiting.append(path)
                else:
                    ready.append(path)
        state.update((live, sorted(set(waiting))))
        if ready:
            yield pd.DataFrame({"codebase_id": [key[0]], "paths": [sorted(set(ready))]})

    return events.groupBy("codebase_id").applyInPandasWithState(step, "codebase_id string, paths array<string>", "live boolean, waiting array<string>", "append", GroupStateTimeout.NoTimeout)


def converging(bursts: DataFrame, previous: Callable[[], DataFrame], current: Callable[[], DataFrame], apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run apply on the actions that each batch of bursts calls for; the state of the disk is read late, when the batch runs."""
    def batch(df: DataFrame, number: int) -> None:
        paths = df.select(F.explode("paths").alias("path")).distinct()
        apply(converge(paths, previous(), current()), number)

    writer = bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()


def sweep(codebases: DataFrame, changed: DataFrame) -> DataFrame:
    """(codebase_id) of the indexed code that a periodic pass must sync: those with a change."""
    due = codebases.where("kind = 'code' and status = 'indexed'").select("codebase_id")
    return due.join(changed.select("codebase_id").distinct(), "codebase_id", "left_semi")
