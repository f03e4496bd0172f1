"""Keyword search from blocks: the rows of the plain search, and how many postings are read for them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import blocks, lexical, retrieval, shaping
from tidewake.service import Service

SF = "/root/testdata/sf0.1"


def rows_of(df):
    return [(r["id"], r["score"]) for r in df.collect()]


def test_the_same_rows_and_under_half_of_the_postings(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = f"file://{tmp_path}/index"
    blocks.write(docs, path, "doc_id", "text")
    read = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(3).collect():
        found = blocks.search(spark, path, r["text"], 10, digits=6)
        plain = retrieval.top(lexical.bm25(docs, r["text"], "doc_id", "text").withColumn("score", F.round("score", 6)), 10)
        assert rows_of(found.rows) == rows_of(plain)
        a, b = found.read()
        read.append(a / b)
    assert np.mean(read) < 0.5, read


@pytest.mark.parametrize("slot, first", [(1, 1), (4, 2)])
def test_random_corpora(spark, tmp_path, monkeypatch, slot, first):
    monkeypatch.setattr(blocks, "FIRST", first)
    rng = random.Random(slot)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 31), k=rng.choice([0, 1, 5, 30])))) for i in range(150)] + [(150, None), (151, ""), (152, "w1 w1 w1")]
    docs = spark.createDataFrame(rows, "id long, content string").repartition(5)
    path = f"file://{tmp_path}/index"
    blocks.write(docs, path, slot=slot)
    some = docs.where("id % 3 = 0").select("id")
    for query in ("W1, w2 w3! nothing w29 w29", ""):
        want = lexical.bm25(docs, query)
        for k in (4, 500):
            for among in (None, some):
                kept = want if among is None else want.join(among, "id", "left_semi")
                got = rows_of(blocks.search(spark, path, query, k, among, digits=9).rows)
                assert got == rows_of(retrieval.top(kept.withColumn("score", F.round("score", 9)), k))


def test_an_empty_corpus(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    blocks.write(spark.createDataFrame([], "id string, content string"), path)
    found = blocks.search(spark, path, "any word", 3)
    assert found.rows.count() == 0 and found.read() == (0, 0)


def test_search_code_uses_the_index_of_the_version(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/state", shaping.hashing_embedder(32))
    src = lambda more="": spark.createDataFrame([(f"d/f{i}.go", f"func f{i}() {{ alpha beta{i} }}\n") for i in range(20)] + [("d/x.py", f"zeta alpha {more}\n")], "path string, content string")
    s.start_index("/r", src())
    got = s.search_code("/r", "zeta", sparse=True, limit=3).collect()
    assert got[0]["relative_path"] == "d/x.py"
    held = tmp_path / "state" / "lexical"
    before = sorted(p.name for p in next(held.iterdir()).iterdir())
    s.search_code("/r/d", "beta7", extensions=["go"], sparse=True, limit=3).collect()
    assert sorted(p.name for p in next(held.iterdir()).iterdir()) == before == ["1"]
    s.sync_index("/r", src("omega"))
    assert s.search_code("/r", "omega", sparse=True, limit=3).collect()[0]["relative_path"] == "d/x.py"
    assert sorted(p.name for p in next(held.iterdir()).iterdir()) == ["2"]
    assert s.clear_index("/r") and not list(held.iterdir())


def test_the_index_is_built_without_a_table_of_postings(spark, tmp_path, monkeypatch):
    kept, real = [], blocks.staged
    monkeypatch.setattr(blocks, "staged", lambda df, name: kept.append(name) or real(df, name))
    docs = spark.createDataFrame([(k, f"a b{k % 3} a {'c ' * k}") for k in range(20)], "id long, content string")
    blocks.write(docs, str(tmp_path))
    assert kept == ["lengths"]
    rows = spark.read.parquet(f"{tmp_path}/blocks")
    assert sum(len(r["ids"]) for r in rows.where("term = 'a'").collect()) == 20 and max(len(r["ids"]) for r in rows.collect()) <= blocks.SLOT
    assert {r["term"]: r["df"] for r in spark.read.parquet(f"{tmp_path}/terms").collect()} == {"a": 20, "b0": 7, "b1": 7, "b2": 6, "c": 19}
