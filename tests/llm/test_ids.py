"""Identifiers that doubles can't hold, beside null ones, come out unchanged from every operator and stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewake.llm import common, decontaminate, exact_dedup, html_text, language_id, ngram_join, packing, resharding, toxicity, vector_codes, warc_zip

IDS = [2**53 - 1, 2**53 + 1, 2**53 + 3, 2**53 + 5, 2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, -(2**53) - 1, None, None, 0]
SF = "/root/testdata/sf0.001"
TEXTS = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(len(IDS))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(zip(IDS, TEXTS)), "doc_id long, text string").coalesce(1)


def ids_of(df, name="doc_id"):
    return sorted((r[name] for r in df.select(name).collect()), key=lambda x: (x is None, x or 0))


WANT = sorted(IDS, key=lambda x: (x is None, x or 0))


@pytest.mark.parametrize("name", ["op1", "op4", "op5", "op6", "op7", "op8", "op9"])
def test_operators(spark, docs, name):
    out = {
        "op1": lambda: ngram_join.join(docs),
        "op4": lambda: decontaminate.scan(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
        "op5": lambda: language_id.predict(docs, language_id.train(["the cat sat on the mat"] * 2, ["en"] * 2, rounds=2)),
        "op6": lambda: toxicity.score(docs, toxicity.Model(np.array([5], np.uint64), np.array([1.0]), top=np.zeros(4))),
        "op7": lambda: resharding.reshard(docs),
        "op8": lambda: exact_dedup.dedup(docs),
        "op9": lambda: packing.pack(docs),
    }[name]()
    assert ids_of(out) == WANT
    if name == "op1":
        assert all(r["component_id"] == r["doc_id"] for r in out.collect())


def test_pages_vectors_and_archives(spark, docs, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a/"), F.col("text")).alias("url"), F.col("text").alias("html"))
    assert ids_of(html_text.extract(pages), "page_id") == WANT
    assert ids_of(warc_zip.read(warc_zip.write(pages, f"file://{tmp_path}/a")), "page_id") == WANT
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"), F.lit(1).alias("label"))
    assert ids_of(vector_codes.compress(vectors, parts=2).rows, "vec_id") == WANT


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    assert ids_of(dict(corpus_pipeline.STAGES)[name](spark, docs, SF)) == WANT


def test_near_copies_of_wide_ids(spark):
    rows = [(2**53 + 1, TEXTS[0]), (2**53 + 3, TEXTS[0] + " x"), (None, TEXTS[1]), (2**53 + 5, TEXTS[1] + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in ngram_join.stage(spark, df, SF).collect()) == [rows[0], rows[3]]


def test_with_ids_keeps_other_columns(spark):
    df = spark.createDataFrame([(2**53 + 1, 1, [2.5]), (None, None, None)], "a long, b int, c array<double>").coalesce(1)
    out = common.with_ids(df, lambda it: it, "b int, a long, c array<double>", "a")
    assert [tuple(r) for r in out.collect()] == [(1, 2**53 + 1, [2.5]), (None, None, None)] and dict(out.dtypes)["a"] == "bigint"
