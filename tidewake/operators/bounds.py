"""Exact nearest neighbours from small codes: bounds of every score first, full vectors for the few that may win.

A vector's code is one signed byte for each component, in steps of its largest component
by 127, with the step and the length of what rounding lost. The product of a query with
the code, plus or minus that length times the query's, bounds the true score (Cauchy and
Schwarz), so the best lower bounds give a floor that no winner is below, and only rows
whose upper bound reaches it are scored in full. Codes hold a quarter of the bytes of
vectors of floats, and bounds are products with a known vector, which compile; it works
on vectors without clusters, where cells save nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot_with
from .retrieval import limit_of, search

STEPS = 127
#: Rows that may be broadcast, counted before: an id each.
MOST_BROADCAST = 500_000
#: What sums in double precision may be wrong by, relative to the score.
ROUNDING = 1e-9
CODE = ("code", "step", "lost")


def coded(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """rows with code (bytes), step and lost; all null for a vector that is null or holds a null, NaN or infinite component."""
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = F.when(sound, F.transform(F.col(vector), lambda x: x.cast("double")))

    def code_of(v: Column, step: Column) -> Column:
        code = F.transform(v, lambda x: F.when(step > 1e-300, F.round(x / step)).otherwise(0.0).cast("tinyint"))  # a step may be too small to divide by
        return let(code, lambda c: F.struct(c.alias("code"), step.alias("step"), (F.sqrt(rest(v, c, step)) * (1 + ROUNDING)).alias("lost")))

    def rest(v: Column, code: Column, step: Column) -> Column:
        return F.aggregate(F.zip_with(v, code, lambda x, c: (x - c * step) * (x - c * step)), F.lit(0.0), lambda s, x: s + x)

    whole = let(v, lambda v: let(F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)) / STEPS, lambda step: F.when(v.isNotNull(), code_of(v, step))))
    return rows.withColumn("_code", whole).select(*rows.columns, *[F.col("_code")[c].alias(c) for c in CODE])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def bounded(codes: DataFrame, query: Sequence[float]) -> DataFrame:
    """codes with low and high, between which the score lies; null where there is no code."""
    size = sum(float(x) ** 2 for x in query) ** 0.5
    near = codes.withColumn("_near", dot_with(F.col("code"), query) * F.col("step"))
    off = F.col("lost") * size + (1 + F.abs("_near")) * ROUNDING
    return near.withColumns({"low": F.col("_near") - off, "high": F.col("_near") + off}).drop("_near")


def candidates(codes: DataFrame, query: Sequence[float], limit: int, digits: int | None = None) -> DataFrame:
    """The rows of codes that may be among the best limit ones; those without a code always may."""
    rows = bounded(codes, query)
    best = rows.select("low").orderBy(F.desc_nulls_last("low")).limit(limit).agg(F.min("low").alias("floor"), F.count("low").alias("n")).first()
    if best["n"] < limit:
        return codes
    floor = best["floor"] - (10.0**-digits if digits is not None else 0.0)  # rounded scores tie within that
    return rows.where(F.col("high").isNull() | (F.col("high") >= floor)).drop("low", "high")


def search_bounded(codes: DataFrame, vectors: DataFrame, query: Sequence[float], *, where: Column | None = None, limit: int | None = None, id_col: str = "id", vector: str = "vector", digits: int | None = None, min_score: float = 0.0) -> DataFrame:
    """retrieval.search over vectors (id_col, vector), with the same rows, read in full only where codes (id_col, columns of where, code, step, lost) leave them in."""
    kept = codes if where is None else codes.where(where)
    ids = candidates(kept, query, limit_of(limit), digits).select(id_col)
    few = ids.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    found = vectors.join(F.broadcast(ids) if few else ids, id_col, "left_semi")
    return search(found, query, limit=limit, id_col=id_col, vector=vector, digits=digits, min_score=min_score)


def write(rows: DataFrame, path: str, columns: Sequence[str] = (), id_col: str = "id", vector: str = "vector") -> None:
    """Keep the codes, with the columns that searches filter by, apart from the vectors."""
    rows = rows.select(id_col, *columns, vector)
    coded(rows, vector).drop(vector).write.mode("overwrite").parquet(f"{path}/codes")
    rows.write.mode("overwrite").parquet(f"{path}/vectors")


def search_written(spark: SparkSession, path: str, query: Sequence[float], **how) -> DataFrame:
    return search_bounded(spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), query, **how)
