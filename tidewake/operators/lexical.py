"""Keyword search by BM25, and its fusion with nearest neighbours by reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import limit_of, order

K1, B, RRF = 1.2, 0.75, 60
TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


def postings(docs: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, term, tf, len) of every document and term."""
    words = docs.select(F.col(id_col).alias("id"), terms(F.col(text)).alias("w")).select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame, query: str, id_col: str = "id", text: str = "content", k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the documents that share a term with the query.

    Texts are cut into words once: of each document its length and those of its words that the query has go through an exchange that both the statistics of the corpus and the search read. Only these words are exploded.
    """
    wanted = [r["t"] for r in docs.sparkSession.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("t")).collect()]  # the query's words
    cut = docs.select(F.col(id_col).alias("id"), terms(F.col(text)).alias("w"))
    sized = cut.select("id", F.size("w").alias("len"), F.filter("w", lambda t: t.isin(wanted)).alias("hits")).repartition("id")
    # the hash keeps all columns, without which the exchange would be another one
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), F.max(F.xxhash64("id", "hits")).alias("_all")).where("_all is not null or n >= 0").select("n", "avg")
    found = sized.select("id", "len", F.explode("hits").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    return weighed(found, stats, k1, b)


def weighed(found: DataFrame, stats: DataFrame, k1: float, b: float) -> DataFrame:
    """(id, score) from (id, len, term, tf) of the query's terms and one row (n, avg)."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return x.groupBy("id").agg(F.sum(part).alias("score"))


def write_index(docs: DataFrame, path: str, id_col: str = "id", text: str = "content") -> None:
    """Postings sorted by term, so that a search reads the files of its terms only, and the corpus' numbers."""
    rows = postings(docs, id_col, text)
    rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    lengths = docs.select(F.size(terms(F.col(text))).alias("len"))
    lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).write.mode("overwrite").parquet(f"{path}/stats")


def bm25_indexed(spark, path: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """As bm25, from an index: the query's terms are a filter that the scan applies."""
    wanted = [r["t"] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("t")).collect()]  # the query's words
    found = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(wanted))
    return weighed(found.select("id", "len", "term", "tf"), spark.read.parquet(f"{path}/stats"), k1, b)


def ranked(rows: DataFrame, size: int, id_col: str = "id") -> DataFrame:
    """(id, rank) of the first size rows."""
    best = rows.orderBy(*order(id_col)).limit(size)
    return best.select(id_col, F.row_number().over(Window.orderBy(*order(id_col))).alias("rank"))  # size rows


def fused(legs: list[DataFrame], limit: int | None = None, id_col: str = "id", k: int = RRF) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank) over the legs that have the row."""
    every = legs[0].select(id_col, "rank")
    for leg in legs[1:]:
        every = every.unionByName(leg.select(id_col, "rank"))
    return every.groupBy(id_col).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score")).orderBy(*order(id_col)).limit(limit_of(limit))


def hybrid(dense: DataFrame, sparse: DataFrame, limit: int | None = None, id_col: str = "id", k: int = RRF) -> DataFrame:
    """Both legs, already filtered alike and scored, cut to max(limit, 10) and fused."""
    size = max(limit_of(limit), 10)
    return fused([ranked(dense, size, id_col), ranked(sparse, size, id_col)], limit, id_col, k)
