"""Vector code compression: product codes learned from distinct parts and their weights.

Components become integers, floor(256 * x). Each vector is cut into equal parts, and of
each position only the distinct parts are kept, with the number of vectors that have them
as weight. Lloyd's rounds run over these: a task assigns its distinct parts to the nearest
entry of the position's codebook and returns weighted sums by entry, so that a round moves
sums of the codebooks' size alone, and the driver holds codebooks alone. At the end codes
and errors, known once for each distinct part, are joined back to the vectors. Parts that
so many vectors share that they could fill a task are at most FEW, whatever the input, and
are broadcast; all others are joined by a shuffle. So are the sums by label.

Defined results: a vector that is null or holds null, NaN or an infinite component gives no
row. The length of the vectors is that of the first one (by identifier) whose length is a
multiple of the number of parts; a vector of another length, an empty one, and one with
components so large that squared distances would not fit a long (for 64 components
741,455 and more) can't be coded: it gives a row with null code and error and teaches
nothing. Null identifiers come after all others; rows that repeat an identifier come in the
order of their integers, and each gives a row; fewer vectors than entries make shorter
codebooks; a null label is a label; an empty table gives an empty table; other columns of
the input play no part. A label's sum that doesn't fit a long is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, small_batches, table, tidily, written

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: A code has two hexadecimal digits.
ENTRIES_MOST = 256
#: Rows whose distances are held at a time.
AT_ONCE = 4096
#: Codes, of two hexadecimal digits each, that are summed up in one long.
IN_A_LONG = 7
#: Codebooks: of each position the entries, of each entry the components.
Books = list[list[list[int]]]


class Compressed(NamedTuple):
    #: (row, vec_id, label, code, error) of every vector.
    rows: DataFrame
    books: Books


def integers(vector: Column, parts: int) -> Column:
    """The vector's integer components; null if it can't be coded."""
    most = F.sqrt(F.lit(2.0**61) / F.size(vector))  # two of them are apart by a number whose square, times the length, is below 2^63
    whole = (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(vector, lambda x: F.abs(x.cast("double") * SCALE) < most)
    return F.when(whole, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def kept(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int) -> DataFrame:
    """(row, vec_id, label, ints) of the vectors without null, NaN and infinite components; row: names the row."""
    vector = F.col(vec_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(vector.isNotNull()).where(finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), integers(vector, parts).alias("ints"))


def cut(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(row, place, part): a row for each part of each vector."""
    places = F.sequence(F.lit(0), F.lit(parts - 1))
    return rows.select("row", F.posexplode(F.transform(places, lambda p: F.slice("ints", p * width + 1, width))).alias("place", "part"))


def nearest(place: np.ndarray, part: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each part's nearest entry, the lowest of several, and its squared distance."""
    code, error = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
    for p, book in enumerate(books):
        own = np.flatnonzero(place == p)
        for at in range(0, len(own), AT_ONCE):
            k = own[at : at + AT_ONCE]
            apart = ((part[k, None, :] - book[None]) ** 2).sum(2)
            code[k] = apart.argmin(1)
            error[k] = apart.min(1)
    return code, error


def columns_of(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """place and part of a batch."""
    part = batch.column(batch.schema.get_field_index("part")).flatten().to_numpy(zero_copy_only=False)
    return batch.column(batch.schema.get_field_index("place")).to_numpy(), part.astype(np.int64).reshape(-1, width)


def improved(distinct: DataFrame, books: Books) -> Books:
    """The codebooks after one round; an entry that nothing is assigned to stays."""
    width, held = len(books[0][0]), distinct.sparkSession.sparkContext.broadcast([np.array(b, np.int64) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(books) * ENTRIES_MOST, width + 1), object)  # Python's integers, which never overflow
        for batch in batches:
            place, part = columns_of(batch, width)
            code, _ = nearest(place, part, held.value)
            weight = batch.column(batch.schema.get_field_index("weight")).to_numpy()
            key = place * ENTRIES_MOST + code
            by = np.argsort(key, kind="stable")
            keys, first = np.unique(key[by], return_index=True)
            x = np.concatenate([np.ones((len(part), 1), np.int64), part], 1)[by]
            if float(weight.max(initial=0)) * float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62:
                x = x.astype(object)
            if len(x):
                sums[keys] += np.add.reduceat(x * weight[by, None], first, axis=0).astype(object)
        rows = [(k // ENTRIES_MOST, k % ENTRIES_MOST, i, int(sums[k, i])) for k in np.flatnonzero(sums[:, 0] != 0).tolist() for i in range(width + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["place", "code", "i", "x"])

    got = distinct.mapInArrow(tidily(run), "place int, code int, i int, x decimal(38,0)").groupBy("place", "code", "i").agg(F.sum("x").alias("x"))
    found = {(r["place"], r["code"], r["i"]): int(r["x"]) for r in got.collect()}  # the size of the codebooks
    held.destroy()
    return [
        [[found[p, c, i + 1] // found[p, c, 0] for i in range(width)] if (p, c, 0) in found else entry for c, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def coded(distinct: DataFrame, books: Books) -> DataFrame:
    """(place, part, weight, part_code, part_error) of every distinct part."""
    width, held = len(books[0][0]), distinct.sparkSession.sparkContext.broadcast([np.array(b, np.int64) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = nearest(*columns_of(batch, width), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array(error)], [*batch.schema.names, "part_code", "part_error"])

    return distinct.mapInArrow(tidily(run), "place int, part array<int>, weight long, part_code int, part_error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes and errors of every vector, and the codebooks; entries: ENTRIES_MOST at most."""
    if not 0 < entries <= ENTRIES_MOST:
        raise ValueError(f"1 to {ENTRIES_MOST} entries")
    small_batches(vectors.sparkSession)
    rows = written(kept(vectors, id_col, vec_col, label_col, parts), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    first = rows.where("ints is not null").orderBy(*order).select("ints").first()
    if first is None:
        return Compressed(rows.select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), [])
    width = len(first["ints"]) // parts
    fit = rows.where(F.size("ints") == width * parts)
    starts = [list(r["ints"]) for r in fit.orderBy(*order).select("ints").limit(entries).collect()]  # entries rows at most
    books = [[v[p * width : (p + 1) * width] for v in starts] for p in range(parts)]
    pieces = cut(fit, parts, width)
    distinct = written(pieces.groupBy("place", "part").agg(F.count(F.lit(1)).alias("weight")), "distinct-parts")
    for _ in range(rounds):
        books = improved(distinct, books)
    values = written(coded(distinct, books), "coded-parts")
    total = values.agg(F.sum("weight")).first()[0]
    found = met(pieces, values, ["place", "part"], total).drop("part")
    # the codes of up to seven places are digits of one number, so a row gathers numbers, not lists
    sums, digits = [], []
    for at in range(0, parts, IN_A_LONG):
        n = min(IN_A_LONG, parts - at)
        digit = F.call_function("shiftleft", F.col("part_code").cast("long"), (8 * (at + n - 1 - F.col("place"))).cast("int"))
        sums.append(F.sum(F.when(F.col("place").between(at, at + n - 1), digit).otherwise(F.lit(0).cast("long"))).alias(f"digits_{at}"))
        digits.append(F.lpad(F.lower(F.hex(f"digits_{at}")), 2 * n, "0"))
    codes = found.groupBy("row").agg(*sums, F.sum("part_error").alias("error")).select("row", F.concat(*digits).alias("code"), "error")
    return Compressed(rows.select("row", "vec_id", "label").join(codes, "row", "left"), books)


def label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the sum of error over the rows of the same label; null is a label."""
    rows = written(rows, "codes")
    by_label = written(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("weight")), "label-errors")
    return met(rows, by_label, ["label"], by_label.agg(F.sum("weight")).first()[0] or 0)


def codebooks_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def decoded(rows: DataFrame, books: Books) -> DataFrame:
    """rows with vector, the components that code stands for: those of its entries, put back in scale; null without a code."""
    held = rows.sparkSession.sparkContext.broadcast([np.array(b, np.float64) / SCALE for b in books])

    @F.pandas_udf("array<double>")
    def vector(code):
        parts = held.value
        return code.map(lambda c: None if c is None else np.concatenate([parts[p][k] for p, k in enumerate(bytes.fromhex(c))]))

    return rows.withColumn("vector", vector("code"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    return label_errors(rows).select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """One assignment of all parts (a<k>) and the codebooks that it gives (b<k + 1>)."""
    distance = " + ".join(f"(p.x{i} - b.x{i}) * (p.x{i} - b.x{i})" for i in range(1, 5))
    floors = ", ".join(f"CASE WHEN count(a.row) = 0 THEN b.x{i} ELSE (sum(a.x{i}) - ((sum(a.x{i}) % count(a.row)) + count(a.row)) % count(a.row)) // count(a.row) END AS x{i}" for i in range(1, 5))
    assign = f"a{k} AS MATERIALIZED (SELECT p.row, p.place, p.x1, p.x2, p.x3, p.x4, min(({distance}) * 64 + b.c) AS m FROM p JOIN b{k} b USING (place) GROUP BY ALL)"
    update = f"b{k + 1} AS MATERIALIZED (SELECT b.place, b.c, {floors} FROM b{k} b LEFT JOIN a{k} a ON a.place = b.place AND a.m % 64 = b.c GROUP BY b.place, b.c, b.x1, b.x2, b.x3, b.x4)"
    return f"{assign}, {update}"


#: For vectors of 64 components with identifiers of their own.
SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT row, vec_id, place, e[4 * place + 1] AS x1, e[4 * place + 2] AS x2, e[4 * place + 3] AS x3, e[4 * place + 4] AS x4 FROM v, (SELECT unnest(range(16)) AS place)
), b0 AS MATERIALIZED (
  SELECT place, c, x1, x2, x3, x4 FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY vec_id NULLS LAST, row) - 1 AS c FROM p) WHERE c < 64
), {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)},
books AS (SELECT sha256(string_agg(concat_ws(',', x1, x2, x3, x4), ',' ORDER BY place, c)) AS s FROM b2),
codes AS (SELECT row, string_agg(printf('%02x', CAST(m % 64 AS BIGINT)), '' ORDER BY place) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT s FROM books) AS codebooks_sha256 FROM v JOIN codes USING (row)
"""
