"""Nulls in any column, empty and very long texts, repeated rows, clashing columns, empty tables: a row for every row, and no crash."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.llm import common, decontaminate, exact_dedup, html_text, language_id, ngram_join, packing, pii, resharding, toxicity

ROWS = [(None, None, None), (None, "a b c d e f", "en"), (1, None, None), (1, None, None), (2, "", "en"), (3, "x" * 150_000, "en"), (3, "x" * 150_000, "en"), (4, "a b c d e f", None), (5, "😀 É\tß", "fr"), (6, "w " * 40_000, "en"), (7, "\x00 \x1c ' \xa0", "en")]
CLASH = ("score", "spans", "text_sha256", "run", "class", "n", "part", "length", "rank", "row", "w", "size", "block", "hot", "component", "slice", "blob")


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.lit("own") for c in CLASH})


def bench(spark):
    return spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a b c d e f")], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d: ngram_join.join(d),
    "op2": lambda s, d: pii.find(d),
    "op4": lambda s, d: decontaminate.scan(d, bench(s)),
    "op5": lambda s, d: language_id.predict(d, language_id.train(["the cat sat on the mat"] * 2, ["en"] * 2, rounds=2)),
    "op6": lambda s, d: toxicity.score(d, toxicity.Model(np.array([5], np.uint64), np.array([1.0]), top=np.zeros(4))),
    "op7": lambda s, d: resharding.reshard(d),
    "op8": lambda s, d: exact_dedup.dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(spark, name):
    df = table(spark)
    out = OPERATORS[name](spark, df).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == sorted((r[0] is None, r[0]) for r in ROWS)
    assert OPERATORS[name](spark, df.limit(0)).count() == 0


def test_packing_keeps_every_row(spark):
    out = packing.pack(table(spark)).where("piece = 0")
    assert out.count() == len(ROWS) and packing.pack(table(spark).limit(0)).count() == 0


def test_pages(spark):
    df = spark.createDataFrame([(None, None, None), (1, "http://a/b", "<p>x"), (1, "http://a/b", "<p>x"), (2, "http://a/c", "<div>" * 3_000 + "y" * 100_000), (3, "", "")], "page_id long, url string, html string").withColumn("host", F.lit("own"))
    assert html_text.extract(df).count() == 5


def test_work_tables_can_be_deleted(spark):
    kept = common.written(spark.range(3), "x")
    folder = common.work_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and os.path.isdir(folder)
    common.forget_work(spark)
    assert not os.path.isdir(folder)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_values_of_the_hard_rows(spark):
    df = table(spark)
    ids = [r[0] for r in ROWS]
    sets = [0, 2, 0, 0, 0, 1, 1, 2, 1, 1, 1]
    tops = [None, 4, 1, 1, 2, 3, 3, 4, 5, 6, 7]
    assert values(ngram_join.join(df), "doc_id", "n_shingles", "component_id") == sorted(zip(ids, sets, tops), key=repr)
    keep, size = [1, 4, 1, 1, 1, 3, 3, 4, 5, 6, 7], [4, 2, 4, 4, 4, 2, 2, 2, 1, 1, 1]
    assert values(exact_dedup.dedup(df), "doc_id", "keep_id", "group_size") == sorted(zip(ids, keep, size), key=repr)
    found = decontaminate.scan(df, bench(spark)).collect()
    hit = sorted(((r["doc_id"], r["n_words"], len(r["covered"]), tuple(r["items"])) for r in found), key=repr)
    n_words = [0, 6, 0, 0, 0, 1, 1, 6, 3, 40_000, 1]
    leak = [(6, ("3",)) if r[1] == "a b c d e f" else (0, ()) for r in ROWS]
    assert hit == sorted(((i, n, *x) for i, n, x in zip(ids, n_words, leak)), key=repr)
    model = language_id.train(["the cat sat on the mat"] * 2, ["en"] * 2, rounds=2)
    letters = ["und", "en", "und", "und", "und", "en", "en", "en", "en", "en", "und"]
    assert values(language_id.predict(df, model), "doc_id", "lang_pred") == sorted(zip(ids, letters), key=repr)
    scores = values(toxicity.score(df, toxicity.Model(np.array([5], np.uint64), np.array([1.0]), top=np.zeros(4))), "doc_id", "score")
    assert scores == sorted(((i, 0.5) for i in ids), key=repr)
    assert values(pii.find(df).withColumn("n", F.size("pii")), "doc_id", "n") == sorted(((i, 0) for i in ids), key=repr)
    placed = resharding.reshard(df, shards=4, old_shards=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in placed) == [(s, k) for s in range(4) for k in range(sum(r["shard"] == s for r in placed))]
