"""What the operators of this subpackage share: reading, let-binding, work tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words and that normalisation folds to one space.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


#: The folders of applications without a shared one, as in tests.
_own: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the shared folder; without one, a temporary folder in local mode and the warehouse on a cluster, where machines share no other."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(app)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = _own[app] = f"file://{tempfile.mkdtemp(prefix='tidewake-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{found.rstrip('/')}/tidewake-{app}"


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def forget_work(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once what was made of them is written."""
    delete(spark, work_dir(spark))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again; cuts the lineage."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made().append(path)
    return spark.read.schema(df.schema).parquet(path)


_here = threading.local()


def made() -> list[str]:
    """The work tables that this thread has written."""
    if not hasattr(_here, "made"):
        _here.made = []
    return _here.made


def forget_but_last(spark: SparkSession, since: int) -> None:
    """Delete the work tables that this thread has written since it had that many, but for the last one: what the others held is in it."""
    *old, last = made()[since:]
    for path in old:
        delete(spark, path)
    made()[since:] = [last]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows' keys that may be broadcast: about 100 bytes each, counted before.
MOST_BROADCAST = 500_000
#: With doc_id what names a row in a decision on rows: ids may be null or repeat.
DIGEST = "_digest"


def digested(docs: DataFrame) -> DataFrame:
    """docs with a digest of the text, which is null if the text is."""
    return docs.withColumn(DIGEST, F.md5("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of which gone has both doc_id and DIGEST (null equals null): of rows with one id only those with the text that was decided on go.

    Few keys are sent to the texts; only many make the texts move.
    """
    gone = written(gone.select(F.col("doc_id").alias("_gone"), F.col(DIGEST).alias("_gone_digest")).distinct(), "gone")
    few = gone.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    same = F.col("doc_id").eqNullSafe(F.col("_gone")) & F.md5("text").eqNullSafe(F.col("_gone_digest"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")


def with_ids(df: DataFrame, run: Callable, schema: str, *ids: str) -> DataFrame:
    """df.mapInPandas(run, schema), where ids, by default the first column of the schema, are longs that pass through as text: pandas would make numbers of doubles of them beside a null.

    Every column of ids that df has goes in as text, and every one of the schema comes out as text and is a number again.
    """
    kinds = dict(x.strip().split(" ", 1) for x in re.split(r",(?![^<]*>)", schema))
    names = ids or (next(iter(kinds)),)
    sent = df.withColumns({c: F.col(c).cast("string") for c in names if c in df.columns})
    back = sent.mapInPandas(run, ", ".join(f"{c} {'string' if c in names else kind}" for c, kind in kinds.items()))
    return back.withColumns({c: F.col(c).cast(kinds[c]) for c in names})


#: Keys that may be broadcast because each has at least this share of all rows: so many at most.
FEW = 10_000


def met(rows: DataFrame, values: DataFrame, on: Sequence[str], total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of values for their key, null equal to null; values: a row for each key, with how many of the total rows have it as weight.

    Keys of a FEW-th of all rows or more are FEW at most and are broadcast, so that no task gets
    all rows of one. how: inner, or left to keep rows without a value.
    """
    heavy = F.col("weight") * FEW >= total
    named = values.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in values.columns if c not in on])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    few = F.broadcast(named.where(heavy))
    gone = [f"_{c}" for c in on] + ["weight"]
    return rows.join(few, same).drop(*gone).unionByName(rows.join(few, same, "left_anti").join(named.where(~heavy), same, how).drop(*gone))


def training_sample(docs: DataFrame, known: DataFrame, label: str, size: int, most_bytes: int, own: bool = False) -> list[tuple[str, object]]:
    """(text, label) of at most size documents of each label, those with the smallest hashes of doc_id, and of at most most_bytes of whole texts in all.

    known: (doc_id, label), with a row for each pair or several equal ones; own: docs has the
    label of each row, and a text counts only under that of its own row. Of rows that repeat a
    doc_id (and label, if own) the shortest text is taken, then that with the smallest digest; a text that doesn't fit
    into what is left of most_bytes is passed over. Hashes below a bound that keeps about twice
    as many as needed come to the driver, so no task sorts a label.
    """
    spark = docs.sparkSession
    counts = {r[0]: max(1, r["n"]) for r in known.groupBy(label).agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # a row for each label
    if not counts:
        return []
    whole = (1 << 64) - 1
    bounds = {k: min(whole, whole * 2 * size // n) - (1 << 63) for k, n in counts.items()}
    at = F.xxhash64(F.col("doc_id"))
    near = F.lit(False)
    for k, bound in bounds.items():
        near = near | ((F.col(label) == F.lit(k)) & (at <= F.lit(bound)))
    ids = sorted(((r[label], r["at"], r["doc_id"]) for r in known.where(near).select(label, at.alias("at"), "doc_id").distinct().collect()), key=lambda r: r[1:])  # about 2 * size rows of each label
    chosen, left = [], dict.fromkeys(counts, size)
    for k, _, doc_id in ids:
        if left[k] > 0:
            left[k] -= 1
            chosen.append((doc_id, k))
    kinds = f"doc_id {dict(known.dtypes)['doc_id']}, {label} {dict(known.dtypes)[label]}"
    keys = ["doc_id", label] if own else ["doc_id"]
    rows = docs.select(*keys, "text").where("text is not null").join(F.broadcast(spark.createDataFrame(chosen, kinds)), keys)
    rows = rows.groupBy("doc_id", label).agg(F.min(F.struct(F.octet_length("text").alias("bytes"), F.md5("text").alias("digest"), "text")).alias("x"))
    rows = written(rows.select("doc_id", label, F.xxhash64("doc_id").alias("at"), "x.bytes", "x.text"), "training")
    picked, held = [], 0
    for r in sorted(rows.select("doc_id", label, "at", "bytes").collect(), key=lambda r: (r["at"], r["doc_id"])):  # at most size rows of each label
        if held + r["bytes"] <= most_bytes:
            held += r["bytes"]
            picked.append((r["doc_id"], r[label]))
    texts = rows.join(F.broadcast(spark.createDataFrame(picked, kinds)), ["doc_id", label]).select(label, "at", "doc_id", "text").collect()  # at most most_bytes of texts
    return [(r["text"], r[label]) for r in sorted(texts, key=lambda r: (str(r[label]), r["at"], r["doc_id"]))]


#: Rows sent to Python at a time, unless the session says otherwise: texts are long. STAGE_ROWS: in a pipeline, whose executors keep the buffers and processes of the stages before.
ARROW_ROWS, STAGE_ROWS, DEFAULT_ROWS = "2000", "500", "10000"


def small_batches(spark: SparkSession, rows: str = ARROW_ROWS) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, rows)


def give_back() -> None:
    """Return memory that this worker process has freed to the system, as workers live on between tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidily(run: Callable) -> Callable:
    """run, a function from batches to batches, and give_back at its end."""
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped
