"""The pipeline's stages against brute force on a small table."""

import re

import corpus_pipeline
from tidewake.llm import toxicity
from tests.llm.test_native import words_of
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.01"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    model = toxicity.fit(docs, labels)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    left = [(i, t) for i, t in rows if model.of_block([(t or "").encode()])[0][0] < 0.5]
    seen, once = set(), []
    for i, t in left:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        if key not in seen:
            seen.add(key)
            once.append((i, t))
    groups = brute(once)
    near = [(i, t) for i, t in once if groups[i][1] == i]
    grams = {tuple(w[i : i + 10]) for w in (words_of(r["text"]) for r in bench.collect()) for i in range(max(1, len(w) - 9))} - {()}
    assert all(len(g) == 10 for g in grams)
    clean = [i for i, t in near if not any(tuple(w[k : k + 10]) in grams for w in [words_of(t)] for k in range(len(w) - 9))]
    out = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) > len(left) and len(once) > len(near) > len(clean) > 50
    assert sorted({r["doc_id"] for r in out}) == clean


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
