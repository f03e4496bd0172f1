"""Rows from JSON lines: logs, journals, registries, rows of a local collection. Gzip is read as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reports import last_events, retained
from .files import drop, recover

LINE_BYTES = 4 * 1024 * 1024
# The messages of the logs that hold counters and spans.
SAMPLE_MESSAGE, SPAN_MESSAGE = "daemon.perf_counters", "daemon.span.completed"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, valid) of the lines of files."""
    return checked(spark.read.text(path).withColumnRenamed("value", "line"))


def checked(text: DataFrame) -> DataFrame:
    """text (line) with valid: a line over LINE_BYTES or that isn't a JSON object is not valid; empty lines go."""
    text = text.where("line != ''")
    ok = (F.octet_length("line") <= LINE_BYTES) & F.coalesce(F.try_parse_json("line").isNotNull() & F.startswith(F.ltrim("line"), F.lit("{")), F.lit(False))
    return text.withColumn("valid", ok)


def samples(logs: DataFrame) -> DataFrame:
    """(at, name, value, live) of every number in the counter messages."""
    fields = F.from_json("line", "map<string,string>")
    rows = logs.where("valid").select(fields.alias("f")).where(F.col("f.msg") == SAMPLE_MESSAGE)
    tall = rows.select(F.to_timestamp("f.time").alias("at"), F.explode("f").alias("name", "value"))
    return tall.where(~F.col("name").isin("time", "msg", "level")).select("at", "name", F.col("value").try_cast("double").cast("long").alias("value"), F.lit(False).alias("live")).where("value is not null")


def spans(logs: DataFrame) -> DataFrame:
    """(at, name, span_id, parent_span_id, job_id, duration_ms) of the span messages."""
    x = F.from_json("line", "time string, msg string, span string, span_id string, parent_span_id string, job_id string, duration_ms double")
    rows = logs.where("valid").select(x.alias("x")).where(F.col("x.msg") == SPAN_MESSAGE)
    return rows.select(F.to_timestamp("x.time").alias("at"), F.col("x.span").alias("name"), "x.span_id", F.when(F.col("x.parent_span_id") != "", F.col("x.parent_span_id")).alias("parent_span_id"), "x.job_id", F.col("x.duration_ms").cast("long").alias("duration_ms"))


def malformed(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count(F.when(~F.col("valid"), 1)).alias("malformed"))


def job_events(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Events of a job journal with offset, their place in the file. strict: a malformed line is an error instead of left out."""
    return events_of(lines(spark, path).withColumn("offset", F.monotonically_increasing_id()), strict)


def events_of(rows: DataFrame, strict: bool = False) -> DataFrame:
    """job_events of lines (line, valid, offset)."""
    if strict:
        rows = rows.withColumn("valid", F.when(~F.col("valid"), F.raise_error(F.lit("malformed line in the job journal")).cast("boolean")).otherwise(True))
    schema = "event string, occurred_at string, job struct<id:string,codebase_id:string,state:string,started_at:string,completed_at:string,updated_at:string,progress:map<string,bigint>>"
    x = rows.where("valid").select("offset", F.from_json("line", schema).alias("x"))
    times = [F.to_timestamp(f"x.job.{c}").alias(c) for c in ("started_at", "completed_at", "updated_at")]
    return x.select("offset", "x.event", F.to_timestamp("x.occurred_at").alias("occurred_at"), F.col("x.job.id").alias("job_id"), "x.job.codebase_id", "x.job.state", *times, "x.job.progress")


def registry(spark: SparkSession, path: str, key: str = "codebases") -> DataFrame:
    """The entries of a registry, which is one JSON document."""
    return spark.read.json(path, multiLine=True).select(F.explode(key).alias("x")).select("x.*")


def collection_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, bool]:
    """The rows of a collection kept as JSON lines, and whether a torn last line was left out; any other bad line is an error."""
    rows = lines(spark, path).withColumn("offset", F.monotonically_increasing_id())
    bad = rows.where("not valid").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("at")).crossJoin(rows.agg(F.max("offset").alias("last"))).first()
    if bad["n"] > 1 or bad["n"] == 1 and bad["at"] != bad["last"]:
        raise ValueError("malformed line in the collection")
    return rows.where("valid").select(F.from_json("line", schema).alias("x")).select("x.*"), bad["n"] == 1


def compact(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rewrite a job journal (a folder of JSON lines) with the last event of the jobs that a compaction keeps; (kept, dropped). The old journal stays until the new one is whole."""
    recover(spark, path)
    latest = last_events(job_events(spark, path))
    kept = retained(latest).select("offset")
    text = lines(spark, path).withColumn("offset", F.monotonically_increasing_id()).join(kept, "offset", "left_semi")
    stage, old = f"{path}_stg", f"{path}_swap_previous"
    text.orderBy("offset").select("line").write.mode("overwrite").text(stage)
    left, all_ = spark.read.text(stage).count(), latest.count()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(at(path), at(old)) or not fs.rename(at(stage), at(path)):
        recover(spark, path)
        raise OSError(f"can't replace the journal {path}")
    drop(spark, old)
    return left, all_ - left
