"""Files as rows, and the sinks that replace a table as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import FILE_BYTES
from ..operators.gates import verdict


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, length): the files below root, by their path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = root.split("://")[-1].rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), "content", "length")


def gated(files: DataFrame, limit: int = FILE_BYTES, excluded: Column | None = None) -> DataFrame:
    """files with reason, why a file isn't indexed (null: it is)."""
    text_ok = F.is_valid_utf8(F.col("content").cast("string")) if dict(files.dtypes)["content"] == "binary" else F.lit(True)
    return files.withColumn("reason", verdict(F.col("path"), F.octet_length("content"), text_ok, excluded=excluded, limit=limit))


def fate(reason: Column) -> Column:
    """What becomes of a file with this reason: processed (none), skipped (too large or not UTF-8: its rows stay as they are) or removed (it isn't to be indexed: its rows go)."""
    return F.when(reason.isNull(), "processed").when(reason.isin("oversize", "non_utf8"), "skipped").otherwise("removed")


def one(spark: SparkSession, root: str, path: str, limit: int = FILE_BYTES) -> DataFrame:
    """(path, content, hash, reason, fate) of one file below root; a file that isn't there is removed."""
    base = root.rstrip("/")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{path}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isFile():
        return spark.createDataFrame([(path, None, None, "not_regular" if fs.exists(at) else "absent", "removed")], "path string, content binary, hash string, reason string, fate string")
    rows = gated(spark.read.format("binaryFile").load(f"{base}/{path}").select(F.lit(path).alias("path"), "content", "length"), limit)
    kept = F.col("reason").isNull()
    return rows.select("path", F.when(kept, F.col("content")).alias("content"), F.when(kept, F.sha2("content", 256)).alias("hash"), "reason", fate(F.col("reason")).alias("fate"))


def captured(files: DataFrame) -> DataFrame:
    """(path, hash) of the files without a reason against them."""
    return files.where("reason is null").select("path", F.sha2("content", 256).alias("hash"))


def allow_listed(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path").distinct(), "path", "left_semi")


def append(rows: DataFrame, path: str, partition: str | None = None, expected: int | None = None) -> int:
    """Write rows to the table at path; returns how many were written, as the writer itself counted them. An error if they aren't as many as expected."""
    from pyspark.sql import Observation

    seen = Observation(f"append-{uuid.uuid4().hex}")
    writer = rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    n = int(seen.get["n"])
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows written, {expected} expected")
    return n


def replace(rows: DataFrame, path: str) -> None:
    """Put rows in place of the table at path: staged beside it, then renamed; the old table stays until the new one is whole."""
    spark = rows.sparkSession
    stage, old = f"{path}_stg", f"{path}_swap_previous"
    rows.write.mode("overwrite").parquet(stage)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise OSError(f"can't set {path} aside")
    if not fs.rename(at(stage), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"can't put {stage} in place")
    fs.delete(at(old), True)


def cache_chunks(chunks: DataFrame, folder: str, collection: str) -> None:
    """Keep the chunks of a collection in place of those kept before, at once."""
    replace(chunks, f"{folder.rstrip('/')}/{collection}")


def cached_chunks(spark: SparkSession, folder: str, collection: str, schema: str | None = None) -> DataFrame | None:
    """The chunks that were kept of a collection; None: none were. A replacement that was cut off is finished or undone first."""
    path = f"{folder.rstrip('/')}/{collection}"
    if recover(spark, path) == "none":
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def recover(spark: SparkSession, path: str) -> str:
    """Finish or undo a replacement that was cut off: kept, restored or none."""
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.delete(at(f"{path}_swap_previous"), True)
        return "kept"
    if fs.exists(at(f"{path}_swap_previous")):
        fs.rename(at(f"{path}_swap_previous"), at(path))
        return "restored"
    return "none"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def drop(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
