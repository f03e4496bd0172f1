"""Bounded and many-query search against the exact scan."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import bounds, many, retrieval

SF = "/root/testdata/sf0.1"


def best(rows, query, k, digits=None):
    """(id, score) by a plain loop."""
    score = lambda v: sum(float(a) * float(b) for a, b in zip(v, query))
    scored = [(i, round(score(v), digits) if digits is not None else score(v)) for i, v in rows if v is not None]
    return sorted(scored, key=lambda x: (-x[1], x[0]))[:k]


def test_every_fiftieth_row_reads_few_full_vectors(spark):
    """The same rows as the exact scan for all ids that 50 divides, and under a fifth of the vectors in full."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").cache()
    codes = bounds.coded(e.select("vec_id", "embedding"), "embedding").drop("embedding").cache()
    rows = e.orderBy("vec_id").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = codes.orderBy("vec_id").collect()
    code, step, lost = (np.array([r[c] for r in got], float) for c in ("code", "step", "lost"))
    queries, read = np.flatnonzero(ids % 50 == 0), []
    for n, i in enumerate(queries):
        near, off = code @ v[i] * step, lost * np.linalg.norm(v[i]) + 1e-9
        true = v @ v[i]
        assert (near - off <= true).all() and (true <= near + off).all()
        kept = near + off >= np.sort(near - off)[-10] - 1e-6
        exact = np.lexsort((ids, -true))[:10]
        assert kept[exact].all()
        read.append(kept.mean())
        if n % 20 == 0:  # and so does Spark
            found = bounds.search_bounded(codes, e, v[i].tolist(), id_col="vec_id", vector="embedding", digits=6)
            want = retrieval.search(e, v[i].tolist(), id_col="vec_id", vector="embedding", digits=6)
            assert [(r["vec_id"], r["score"]) for r in found.collect()] == [(r["vec_id"], r["score"]) for r in want.collect()]
            assert bounds.candidates(codes, v[i].tolist(), 10, 6).count() <= 0.2 * len(ids)
    assert np.mean(read) < 0.05 and max(read) < 0.2, (np.mean(read), max(read))
    e.unpersist(), codes.unpersist()


def test_bounds_of_odd_vectors(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 1e-320, 1e-12, 1e12, rng.gauss(0, 1)]) for _ in range(5)]) for i in range(200)] + [(200, [0.0] * 5), (201, None), (202, [0.5, -0.5, 0.25, 0.0, 1.0]), (203, [0.5, -0.5, 0.25, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, r[0] % 3) for r in rows], "id long, vector array<double>, kind int")
    path = f"file://{tmp_path}/v"
    bounds.write(df, path, ["kind"])
    assert "vector" not in spark.read.parquet(f"{path}/codes").columns
    for query in ([1.0, 2.0, -1.0, 0.5, 0.0], [0.0] * 5):
        for k in (7, 300):
            got = bounds.search_written(spark, path, query, limit=k)
            want = retrieval.search(df, query, limit=k)
            assert [(r["id"], r["score"]) for r in got.collect()] == [(r["id"], r["score"]) for r in want.collect()]
        got = bounds.search_bounded(spark.read.parquet(f"{path}/codes"), df, query, where=F.col("kind") == 1, limit=4)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in retrieval.search(df, query, where=F.col("kind") == 1, limit=4).collect()]
    bad = spark.createDataFrame([(1, [math.nan, 1.0]), (2, [math.inf, 0.0]), (3, [None, 1.0]), (4, [1.0, 1.0])], "id long, vector array<double>")
    codes = bounds.coded(bad)
    assert {r["id"]: r["code"] is None for r in codes.collect()} == {1: True, 2: True, 3: True, 4: False}
    assert bounds.candidates(codes, [1.0, 1.0], 1).count() == 4  # those can't be left out
    assert bounds.candidates(codes.limit(0), [1.0, 1.0], 1).count() == 0


@pytest.mark.parametrize("size", [many.PASS, 7])
def test_many_queries_are_the_plain_loop(spark, monkeypatch, size):
    monkeypatch.setattr(many, "PASS", size)
    monkeypatch.setattr(many, "BLOCK", 3)
    rng = random.Random(2)
    rows = [(2**53 + i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(400)] + [(1, None)]
    asked = [(i % 9, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(25)] + [(None, [1.0, 0.0, 0.0, 0.0]), (3, None)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").repartition(7)
    q = spark.createDataFrame(asked, "query long, vector array<double>")
    got = sorted((tuple(r) for r in many.nearest(df, q, 6).collect()), key=repr)
    want = sorted(((i, j, s, k + 1) for i, v in asked if v is not None for k, (j, s) in enumerate(best(rows, v, 6))), key=repr)
    assert got == want


def test_many_queries_over_named_rows_and_none(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vector array<float>")
    q = spark.createDataFrame([("x", [1.0, 0.5])], "query string, vector array<float>")
    assert [tuple(r) for r in many.nearest(df, q, 2).orderBy("rank").collect()] == [("x", "a", 1.0, 1), ("x", "b", 1.0, 2)]
    assert many.nearest(df, q.limit(0)).count() == 0 and many.nearest(df.limit(0), q).count() == 0
    assert many.nearest(df, df.select(F.col("id").alias("query"), "vector"), 1).count() == 3
    with pytest.raises(Exception, match="sizes"):
        many.nearest(spark.createDataFrame([("z", [1.0])], df.schema), q).collect()


def test_no_row_for_a_pair_is_shuffled(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = many.nearest(e.repartition(4), asked, 10, id_col="vec_id", vector="embedding")
    assert found.count() == 400
    b = many.Best(2, 3)
    for k in range(50):
        b.add(0, np.array([[k % 7, k % 5], [1, 1]], float), np.array([2 * k, 2 * k + 1]))
    query, score, ids = b.cut()
    assert query.tolist() == [0, 0, 0, 1, 1, 1] and score.tolist() == [6, 6, 6, 1, 1, 1] and ids.tolist()[3:] == [0, 1, 2]


def test_best_rows_are_held_in_bounds_and_nan_hides_none(monkeypatch):
    monkeypatch.setattr(many, "MORE", 64)
    scores = np.random.default_rng(3).integers(0, 50, (8, 3_000)).astype(float)
    scores[:, ::2] = np.nan
    best, held = many.Best(8, 5), []
    for k in range(0, 3_000, 100):
        best.add(0, scores[:, k : k + 100], np.arange(k, k + 100))
        held.append(best.held)
    query, score, ids = best.cut()
    for q in range(8):
        wanted = sorted((-x, k) for k, x in enumerate(scores[q]) if x == x)[:5]
        assert [(-x, k) for x, k in zip(score[query == q], ids[query == q])] == wanted


def test_of_a_block_only_rows_that_can_be_among_the_best_are_held():
    best = many.Best(4, 5)
    best.add(0, np.random.default_rng(3).permutation(20_000).reshape(4, 5_000).astype(float), np.arange(5_000))
    assert best.held == 4 * 5
