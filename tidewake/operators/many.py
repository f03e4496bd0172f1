"""The nearest neighbours of many queries at once: blocks of products, the best of each task, and their merge.

Queries are taken in passes of a bounded number, whose vectors are broadcast. A task
multiplies its rows by blocks of queries and keeps, for every query, its best rows so far;
only these leave it, so what is shuffled is limit rows for each query and task, never a
row for a pair. The best of all tasks are ranked by query, and Spark cuts each side to
limit rows before that shuffle too. Each pass is written once, so that plan and driver
hold one pass, however many queries there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged, work_dir
from .retrieval import limit_of

#: Queries of one pass, about; their vectors are what is broadcast.
PASS = 16_384
#: Queries and rows that are multiplied at a time.
BLOCK, ROWS = 512, 1024


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector, these vectors)."""
    has = ~np.asarray(column.is_null())
    values = column.filter(pa.array(has))
    sizes = set(np.diff(values.offsets.to_numpy()).tolist()) - {size}
    if sizes:
        raise ValueError(f"vectors of sizes {size} and {min(sizes)}")
    flat = values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return has, flat.reshape(-1, size)


#: Rows that are held beside twice the best ones before they are cut.
MORE = 1 << 16


class Best:
    """The best limit rows of every query, of those seen so far: by score, then the smaller id."""

    def __init__(self, queries: int, limit: int):
        self.limit, self.floor = limit, np.full(queries, -np.inf)
        self.query, self.score, self.ids = [], [], []
        self.held = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a row for each query from first on, a column for each id."""
        floor = self.floor[first : first + len(scores), None]
        if scores.shape[1] > self.limit:  # no more than limit rows, and their equals, can be among the best
            floor = np.fmax(floor, np.partition(scores, -self.limit, 1)[:, [-self.limit]])
        q, k = np.nonzero(scores >= floor)
        self.query.append(q + first)
        self.score.append(scores[q, k])
        self.ids.append(ids[k])
        self.held += len(q)
        if self.held > 2 * self.limit * len(self.floor) + MORE:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.query:
            return np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        query, score, ids = (np.concatenate(x) for x in (self.query, self.score, self.ids))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.limit - 1
        self.floor[query[last]] = score[last]
        keep = place < self.limit
        query, score, ids = query[keep], score[keep], ids[keep]
        self.query, self.score, self.ids, self.held = [query], [score], [ids], len(query)
        return query, score, ids


def nearest(rows: DataFrame, queries: DataFrame, limit: int | None = None, *, id_col: str = "id", vector: str = "vector", query_col: str = "query", query_vector: str = "vector", digits: int | None = None) -> DataFrame:
    """(query_col, id_col, score, rank): of each row of queries its best limit rows by score, then id; rank from 1.

    rows and queries without a vector have no neighbours and are none; vectors of several sizes are an error; ids aren't null. Queries with one id are told apart by their rows, and each has its own ranks.
    """
    spark, limit = rows.sparkSession, limit_of(limit)
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.monotonically_increasing_id().alias("_row"), F.col(query_col).alias("_query"), F.col(query_vector).alias("_vector"))
    asked = staged(asked, "queries")
    passes = max(1, -(-asked.count() // PASS))
    kept = rows.where(F.col(vector).isNotNull()).select(id_col, vector)
    kind = dict(rows.dtypes)[id_col]
    arrow = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
    kept = kept.withColumn(id_col, F.col(id_col).cast("long" if arrow == pa.int64() else "string"))
    path = f"{work_dir(spark)}/nearest-{uuid.uuid4().hex}"
    wrote = False
    for k in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("_row"), F.lit(passes)) == k).select("_row", "_vector").collect()  # about PASS rows
        if not mine:
            continue
        sizes = {len(r["_vector"]) for r in mine}
        if len(sizes) > 1:
            raise ValueError(f"vectors of sizes {min(sizes)} and {max(sizes)}")
        held = spark.sparkContext.broadcast((np.array([r["_row"] for r in mine], np.int64), np.array([r["_vector"] for r in mine], np.float64)))
        del mine

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, known = held.value
            best = Best(len(names), limit)
            for batch in batches:
                has, some = matrix(batch.column(1), known.shape[1])
                ids = np.array(batch.column(0).filter(pa.array(has)).to_pylist(), np.int64 if arrow == pa.int64() else None)
                for k in range(0, len(some), ROWS):
                    for at in range(0, len(known), BLOCK):
                        scores = known[at : at + BLOCK] @ some[k : k + ROWS].T
                        best.add(at, scores if digits is None else np.round(scores, digits), ids[k : k + ROWS])
            query, score, ids = best.cut()
            for at in range(0, len(query), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[query[part]]), pa.array(ids[part].tolist(), arrow), pa.array(score[part])], ["_row", "_id", "score"])

        found = kept.mapInArrow(run, f"_row long, _id {'long' if arrow == pa.int64() else 'string'}, score double")
        rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("score"), "_id"))
        found.withColumn("rank", rank).where(F.col("rank") <= limit).write.mode("append").parquet(path)
        held.destroy()
        wrote = True
    schema = f"_row long, _id {'long' if arrow == pa.int64() else 'string'}, score double, rank int"
    best = spark.read.schema(schema).parquet(path) if wrote else spark.createDataFrame([], schema)
    return best.join(asked.select("_row", "_query"), "_row").select(F.col("_query").alias(query_col), F.col("_id").cast(kind).alias(id_col if id_col != query_col else f"{id_col}_found"), "score", "rank")
