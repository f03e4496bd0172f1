"""Vectors of equal content are taken over instead of computed again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import catalog_key, content_key
from ..functions.status import same_model
from ..session import staged
from .bloom import Bloom


def seed(stores: Sequence[DataFrame], scope=None) -> DataFrame:
    """(content_hash, content, embedding_model, vector, priority) of stores in order; scope: a predicate on their rows.

    Rows of old stores without a hash get the hash of their content. A catalog (content_hash, model, vector) holds no content and is trusted by its hash.
    """
    out = None
    for n, s in enumerate(stores):
        rows = s.withColumns({"content": F.lit(None).cast("string"), "embedding_model": F.col("model")}) if "content" not in s.columns else s if scope is None else s.where(scope)
        rows = rows.select(F.coalesce("content_hash", content_key(F.col("content"))).alias("content_hash"), "content", "embedding_model", "vector", F.lit(n).alias("priority"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no store to reuse vectors from")
    return out


def reuse(chunks: DataFrame, stores: Sequence[DataFrame], model: str = "", scope=None) -> DataFrame:
    """chunks with vector, and reused: whether a store had it.

    Of several rows the first store wins, in it an exact model before an unnamed one. The chunks' keys are reduced before the join, so a content that very many chunks share meets the stores once; of the stores only rows that a filter of these keys lets through leave their scan, if the stores are large.
    """
    keyed = chunks.drop("vector").withColumn("content_hash", content_key(F.col("content")))
    wanted = keyed.select("content_hash", F.col("content").alias("_content")).groupBy("content_hash").agg(F.first("_content").alias("_content"))
    stored = seed(stores, scope)
    if size_of(stored) >= LEAST_BYTES:
        wanted = staged(wanted, "wanted")
        stored = offered(stored, wanted)
    rows = stored.join(wanted, "content_hash").where((F.col("content").isNull() | (F.col("content") == F.col("_content"))) & same_model(F.col("embedding_model"), F.lit(model)))
    exact = F.coalesce(F.col("embedding_model"), F.lit("")) != model
    best = rows.groupBy("content_hash").agg(F.min_by("vector", F.struct("priority", exact.alias("other"), F.xxhash64("vector").alias("tie"))).alias("vector"), F.min("priority").alias("store"))
    return keyed.join(best, "content_hash", "left").withColumn("reused", F.col("vector").isNotNull())


#: Stores of fewer bytes, by Spark's own estimate, are shuffled as they are: a filter would cost more than it saves.
LEAST_BYTES = 256 << 20


def size_of(df: DataFrame) -> int:
    """What Spark takes the size of a table in bytes to be, from its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def offered(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """The stored rows whose content_hash may be among the wanted ones, told before they are shuffled: those that are, and about one of a thousand others."""
    known = Bloom(wanted.select("content_hash"))
    return stored.where(known.may_hold(F.col("content_hash")))


def overlay(own: DataFrame, wide: DataFrame) -> DataFrame:
    """(content_hash, vector): an item's own vectors before those of the whole build."""
    both = own.select("content_hash", "vector", F.lit(0).alias("p")).unionByName(wide.select("content_hash", "vector", F.lit(1).alias("p")))
    return both.groupBy("content_hash").agg(F.min_by("vector", "p").alias("vector"))


def append(catalog: DataFrame, vectors: DataFrame) -> DataFrame:
    """The rows that the catalog lacks, each key once."""
    keyed = vectors.select(catalog_key(F.col("content_hash"), F.col("model")).alias("catalog_key"), "content_hash", "model", "vector")
    one = F.row_number().over(Window.partitionBy("catalog_key").orderBy(F.xxhash64("vector")))
    new = keyed.join(catalog.select("catalog_key"), "catalog_key", "left_anti")
    return new.withColumn("_n", one).where("_n = 1").drop("_n")


def looked_up(found: DataFrame, rows: DataFrame, key: str = "label") -> DataFrame:
    """rows of the labels that an index found; a label without a row is an error."""
    joined = found.join(rows.withColumn("_in", F.lit(1)), key, "left")
    known = F.when(F.col("_in").isNull(), F.raise_error(F.concat(F.lit("unknown label "), F.col(key).cast("string"))).cast("int")).otherwise(F.col("_in"))
    return joined.withColumn("_in", known).where("_in = 1").drop("_in")
