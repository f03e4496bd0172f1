"""The pipeline's filtering stages on null and repeated doc_ids: decisions hold for rows, not for ids."""

import pytest

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tidewake.llm import common, decontaminate, exact_dedup, ngram_join, packing, toxicity

SF = "/root/testdata/sf0.01"
A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")


def left(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()), key=repr)


@pytest.mark.parametrize("most", [common.MOST_BROADCAST, 0])
def test_decisions_on_texts(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).orderBy("score", "doc_id").collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic, clean = text[scored[-1]["doc_id"]], text[scored[0]["doc_id"]]
    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    for stage, bad, good in ((toxicity.stage, toxic, clean), (decontaminate.stage, f"x {item} y", C)):
        rows = [(None, bad), (None, bad), (None, good), (None, None), (5, bad), (5, good), (5, good), (6, bad), (7, good)]
        assert left(spark, stage, rows) == sorted([r for r in rows if r[1] != bad], key=repr)


def test_copies(spark):
    rows = [(None, A), (None, A), (2, A), (1, f" {A}".strip().replace(" ", "  ")), (2, B), (3, B), (3, C), (3, C), (None, "q r"), (None, "q r"), (None, None), (9, "")]
    kept = [rows[3], (2, B), (3, C), (3, C), (None, "q r"), (None, "q r"), (9, "")]
    assert left(spark, exact_dedup.stage, rows) == sorted(kept, key=repr)


def test_near_copies(spark):
    near = lambda t: t + " z"
    rows = [(None, near(A)), (2, A), (2, C), (3, near(C)), (3, B), (None, near(C)), (None, "q r"), (None, "Q r"), (None, None), (4, ""), (4, "")]
    kept = [(2, A), (2, C), (3, B), (None, "q r"), (None, "Q r"), (None, None), (4, ""), (4, "")]
    assert left(spark, ngram_join.stage, rows) == sorted(kept, key=repr)


CLASH = ("score", "spans", "digest", "check_hash", "run", "class", "name", "n", "part", "length", "rank", "row", "w", "size", "hit", "items", "covered", "words", "row_key", "keep_id", "kept", "component", "slice", "blob", "signature", "found")


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_long_texts_and_clashing_names(spark, name):
    """Rows come through whole, with their own columns; the last stage packs each row for itself."""
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (1, long + " end"), (2, "a" * 2_000_000), (3, ""), (4, None), (None, B), (5, " \x00 \x1f é😀 "), (6, C)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for c in CLASH})
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    if name == "pack":
        got = out.collect()
        texts = packing.encoder_for(None)
        sizes = [len(x) // 4 + 1 for x in texts.encode([t for _, t in rows])]
        assert sum(r["length"] for r in got) == sum(sizes) and sum(r["piece"] == 0 for r in got) == len(rows)
        bins = {}
        for r in got:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert all(sum(n for _, n in b) <= 4096 and sorted(b)[0][0] == 0 for b in bins.values())
        return
    got = out.collect()
    assert out.columns == docs.columns
    # a row that is equal to one before, or nearly, is gone; of those that share the smallest doc_id both stay
    gone = [(4, None)] if name == "exact_dedup" else []
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(r for r in rows if r not in gone)
    assert all(r[c] == f"{c}{'?' if r['doc_id'] is None else r['doc_id']}" for r in got for c in CLASH)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_stages_send_small_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []

    def stop(*_, **__):
        seen.append(int(spark.conf.get(name)))
        raise LookupError

    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for module, inner in ((toxicity, "fit"), (ngram_join, "join"), (packing, "pack")):
        monkeypatch.setattr(module, inner, stop)
        spark.conf.set(name, common.DEFAULT_ROWS)
        try:
            with pytest.raises(LookupError):
                monkeypatch.setattr(module, "table", lambda *_: docs, raising=False)
                module.stage(spark, docs, "")
        finally:
            spark.conf.set(name, before)
    assert len(seen) == 3 and max(seen) <= 500  # an executor's JVM keeps the buffers of the largest batches of all stages
