"""Ranked retrieval: exact nearest neighbours with filters, floors, caps, and overlaps removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, dot_with, literal

DEFAULT_LIMIT = 10


def limit_of(limit: int | None) -> int:
    return limit if limit and limit > 0 else DEFAULT_LIMIT


def order(id_col: str = "id") -> list[Column]:
    return [F.desc("score"), F.asc(id_col)]


def scored(rows: DataFrame, query: Sequence[float] | Column, vector: str = "vector", digits: int | None = None) -> DataFrame:
    """rows with their score: the dot product with the query vector."""
    score = dot(F.col(vector), query) if isinstance(query, Column) else dot_with(F.col(vector), query)
    return rows.withColumn("score", F.round(score, digits) if digits is not None else score)


def top(rows: DataFrame, limit: int | None = None, id_col: str = "id", min_score: float = 0.0, offset: int = 0) -> DataFrame:
    """The best rows by score, then id, after the first offset ones; a floor only if it is above 0."""
    kept = rows.where(F.col("score") >= min_score) if min_score > 0 else rows
    best = kept.orderBy(*order(id_col)).limit(limit_of(limit) + max(offset, 0))
    return best.offset(offset) if offset > 0 else best


def capped(rows: DataFrame, group: str, cap: int, id_col: str = "id", min_score: float = 0.0) -> DataFrame:
    """At most cap rows of each group, the best ones; 0: all. The rank filter is also applied before the shuffle.

    Rows below the floor rank last, so the floor can follow the cap, and scores are computed once.
    """
    kept = rows
    if cap > 0:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order(id_col)))
        kept = rows.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")
    return kept.where(F.col("score") >= min_score) if min_score > 0 else kept


def search(rows: DataFrame, query: Sequence[float] | Column, *, where: Column | None = None, limit: int | None = None, group: str | None = None, cap: int = 0, min_score: float = 0.0, id_col: str = "id", vector: str = "vector", digits: int | None = None, offset: int = 0) -> DataFrame:
    """Filter, score, cap, rank: filters reach the scan, and no page is ever fetched twice."""
    kept = rows if where is None else rows.where(where)
    ranked = scored(kept, query, vector, digits)
    if group:
        ranked = capped(ranked, group, cap, id_col, min_score)
    return top(ranked, limit, id_col, min_score, offset)


def search_in(rows: DataFrame, ids: DataFrame, key: str, query: Sequence[float] | Column, **how) -> DataFrame:
    """search over the rows of many ids, given as a table."""
    return search(rows.join(ids.select(key).distinct(), key, "left_semi"), query, **how)


def merged(batches: Sequence[DataFrame], limit: int | None = None, id_col: str = "id") -> DataFrame:
    """The best of several rankings of different rows."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return top(out, limit, id_col)


def approximate(rows: DataFrame, query: Sequence[float] | Column, centres: Sequence[Sequence[float]], probes: int, *, limit: int | None = None, id_col: str = "id", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """search over the rows of the probes cells whose centres are nearest to the query.

    rows must have a column cell, the number of the nearest centre (see assign_cells); a table partitioned by cell is pruned to the probed ones.
    """
    q = query if isinstance(query, Column) else literal(query)
    near = F.slice(F.array_sort(F.array(*[F.struct((-dot(literal(c), q)).alias("d"), F.lit(i).alias("cell")) for i, c in enumerate(centres)])), F.lit(1), F.lit(probes))
    probed = [r["cell"] for r in rows.sparkSession.range(1).select(F.explode(near).alias("x")).select("x.cell").collect()]  # probes rows
    return search(rows.where(F.col("cell").isin(probed)), query, limit=limit, id_col=id_col, vector=vector, digits=digits)


def assign_cells(rows: DataFrame, centres: Sequence[Sequence[float]], vector: str = "vector") -> DataFrame:
    """rows with cell, the number of the nearest centre, the first of equally near ones; the centres are one value that each row goes through, so the code doesn't grow with them."""
    known = F.array(*[F.struct(F.lit(-i).alias("n"), literal(c).alias("c")) for i, c in enumerate(centres)])
    best = F.array_max(F.transform(known, lambda k: F.struct(dot(F.col(vector), k["c"]).alias("d"), k["n"].alias("n"))))
    return rows.withColumn("cell", -best["n"])


#: Vectors that centres are fitted on, at most.
FIT_ROWS = 4096


def fitted_centres(rows: DataFrame, cells: int, vector: str = "vector", id_col: str = "id", rounds: int = 10) -> list[list[float]]:
    """Centres of cells by k-means over the directions of at most FIT_ROWS vectors, those whose ids have the smallest hashes."""
    import numpy as np

    some = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(vector).limit(FIT_ROWS).collect()
    v = np.array([r[0] for r in some], float)
    if not len(v):
        return []
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    centres = v[:cells].copy()
    for _ in range(rounds):
        near = (v @ centres.T).argmax(1)
        for k in range(len(centres)):
            mine = v[near == k]
            if len(mine):
                centres[k] = mine.sum(0) / max(np.linalg.norm(mine.sum(0)), 1e-12)
    return centres.tolist()


def write_cells(rows: DataFrame, centres: Sequence[Sequence[float]], path: str, vector: str = "vector") -> None:
    """Keep rows by cell, with the centres beside them, so that a search opens the folders of the cells it probes only. Every row is in one cell."""
    assign_cells(rows, centres, vector).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_cells(spark: SparkSession, path: str, query: Sequence[float], probes: int, **how) -> DataFrame:
    """approximate over what write_cells kept; with as many probes as cells the exact search."""
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]  # a row for each cell
    return approximate(spark.read.parquet(f"{path}/rows"), query, centres, probes, **how)


def without_overlaps(rows: DataFrame, path: str = "relative_path", rank: str = "rank", start: str = "start_line", end: str = "end_line") -> DataFrame:
    """In rank order, rows without those of which over half the lines lie in one row of the same file that is kept.

    rows: the result of a search, so a file has no more rows than the search's limit.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(start).alias("s"), F.col(end).alias("e"))))
    empty = F.array().cast("array<struct<rank:int,s:int,e:int>>")

    def step(kept: Column, x: Column) -> Column:
        lines = x["e"] - x["s"] + 1
        common = lambda k: F.least(k["e"], x["e"]) - F.greatest(k["s"], x["s"]) + 1
        inside = F.exists(kept, lambda k: (common(k) > 0) & (lines > 0) & (common(k) / lines > 0.5))
        return F.when(inside, kept).otherwise(F.concat(kept, F.array(x)))

    typed = F.transform(items, lambda x: F.struct(x["rank"].cast("int").alias("rank"), x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e")))
    kept = rows.groupBy(path).agg(typed.alias("items")).select(path, F.explode(F.aggregate("items", empty, step)).alias("x")).select(path, F.col("x.rank").alias(rank))
    return rows.join(kept, [path, rank], "left_semi")
