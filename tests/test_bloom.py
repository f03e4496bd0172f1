"""The filter of wanted contents: nothing wanted is lost, little else leaves the stores."""

import pytest
from pyspark.sql import functions as F

from tidewake.functions.keys import content_key
from tidewake.operators import bloom, reuse


def test_what_is_in_passes_and_little_else(spark):
    keys = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    held = bloom.Bloom(keys)
    assert keys.where(held.may_hold(F.col("k"))).count() == 20_000
    others = spark.range(20_000, 120_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    assert others.where(held.may_hold(F.col("k"))).count() < 0.005 * 100_000
    null = spark.createDataFrame([(None,)], "k string")
    assert null.where(held.may_hold(F.col("k"))).count() == 0
    none = bloom.Bloom(null)
    assert others.where(none.may_hold(F.col("k"))).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_NUMBERS", 1 << 10)
    keys = spark.range(30_000).select(F.col("id").cast("string").alias("k"))
    assert keys.where(bloom.Bloom(keys).may_hold(F.col("k"))).count() == 30_000


@pytest.mark.parametrize("least", [0, 1 << 60])
def test_stores_shuffle_wanted_rows_alone(spark, monkeypatch, least):
    monkeypatch.setattr(reuse, "LEAST_BYTES", least)
    store = spark.range(50_000).select(content_key(F.concat(F.lit("text "), "id")).alias("content_hash"), F.concat(F.lit("text "), "id").alias("content"), F.lit("m").alias("embedding_model"), F.array(F.col("id").cast("float")).alias("vector"))
    chunks = spark.range(0, 100_000, 50).select(F.col("id").alias("n"), F.concat(F.lit("text "), "id").alias("content"), F.lit(None).cast("array<float>").alias("vector"))
    wanted = chunks.select(content_key(F.col("content")).alias("content_hash")).distinct()
    left = reuse.offered(reuse.seed([store]), wanted).count()
    assert 1_000 <= left <= 1_000 + 0.02 * 2_000
    got = reuse.reuse(chunks, [store], "m")
    assert {(r["n"], r["reused"], (r["vector"] or [None])[0]) for r in got.collect()} == {(i, i < 50_000, float(i) if i < 50_000 else None) for i in range(0, 100_000, 50)}
    assert ("shiftleft" in got._jdf.queryExecution().optimizedPlan().toString()) == (least == 0)  # the filter stands before the join
