"""Bounded samples of labelled rows: whole texts, no row twice, rows without doc_id are never learned from; models against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from tidewake.llm import common, language_id, toxicity


def test_sample_is_bounded_whole_and_without_repeats(spark):
    rows = [(i, f"text {i} " + "w" * (i % 50), "a" if i % 3 else "b") for i in range(600)] + [(5, "hot", "a")] * 500 + [(None, "null", "a"), (3_000, None, "b"), (3_001, "x" * 5_000_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    known = df.where("doc_id is not null").select("doc_id", "lang")
    got = common.training_sample(df, known, "lang", 50, 100_000)
    assert {k: sum(1 for _, x in got if x == k) for k in "ab"} == {"a": 50, "b": 50} or len(got) == 99  # a text that is null or too long may have been among them
    assert len(set(got)) == len(got) and all(len(t) < 5_000_000 and t != "null" for t, _ in got)
    assert {t for t, _ in got} <= {t for _, t, _ in rows}
    assert got == common.training_sample(df.repartition(2), known, "lang", 50, 100_000)
    assert sum(len(t) for t, _ in common.training_sample(df, known, "lang", 50, 1_000)) <= 1_000
    whole = common.training_sample(df, known, "lang", 10_000, 10_000_000)
    assert len(whole) == 601 and ("hot", "a") in whole  # of a repeated doc_id the shortest text
    assert common.training_sample(df.limit(0), known.limit(0), "lang", 10, 10) == []


def test_rows_without_doc_id_are_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "the cat", "en"), (1, "the dog", "en"), (4, "a cow", None)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for module, n, rest in ((language_id, 4, 2), (toxicity, 5, 0)):
        want = {None: True} | {r[0]: r[1] for r in docs.where("doc_id is not null").select("doc_id", F.expr(f"crc32(cast(doc_id as string)) % {n} = {rest}")).collect()}
        assert {r["doc_id"]: r["held_out"] for r in module.query(spark, str(tmp_path)).collect()} == want


def test_scores_against_a_plain_chain_over_every_word():
    rng = np.random.default_rng(2)
    vocab = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocab, rng.integers(5, 40))) + (" vile rotten" if k % 3 == 0 else " fine") for k in range(90)]
    model = toxicity.train(texts, np.array([int(k % 3 == 0) for k in range(90)]))
    assert model.top is not None
    for text in [*texts[:12], "", "vile", "x " * 300 + "vile", "vile " * 50]:
        kinds, _, _, first = toxicity.features([text.encode()])
        at, ids = model.find(kinds)
        n = int(first[1])
        emission = model.bias + np.bincount(at, model.weight[ids], n)
        p = toxicity.forward_backward(emission[None], np.ones((1, n), bool), model.trans)[0][0] if n else np.empty(0)
        known = np.unique(at)
        (score, spans), = model.of_block([text.encode()])
        assert np.isclose(score, model.score(p[known], n), atol=1e-9) and len(spans) == (p[known] >= 0.5).sum()


def test_pooled_probabilities_against_a_plain_loop():
    m = language_id.train(["the cat and this dog"] * 3, ["en"] * 3, rounds=3)
    m = language_id.Model(["en", "fr"], [*m.weights[:4], np.random.default_rng(1).normal(size=(20, 2)).astype(np.float32), np.zeros(2, np.float32)])
    tf, uf, tb, ub, v, c = m.weights
    sig = lambda x: 1 / (1 + np.exp(-x))

    def run(data, table, u):
        h, out = np.zeros(10), []
        for b in data:
            g = h @ u
            z, r = sig(table[b][:10] + g[:10]), sig(table[b][10:20] + g[10:20])
            new = np.tanh(table[b][20:] + r * g[20:])
            h = (1 - z) * new + z * h
            out.append(h)
        return np.array(out)

    text = "The CAT été and some more words to fill more than one window. ".encode() * 5
    data, total = language_id.folded(text), np.zeros(2)
    for k in range(0, len(data), language_id.WINDOW):
        w = data[k : k + language_id.WINDOW]
        logits = np.hstack([run(w, tf, uf), run(w[::-1], tb, ub)[::-1]]) @ v + c
        e = np.exp(logits - logits.max(1, keepdims=True))
        total += (e / e.sum(1, keepdims=True)).sum(0)
    assert np.allclose(m.pooled([b"x", text])[1], total / len(data), atol=1e-4)


def test_text_and_label_of_one_row(spark):
    df = spark.createDataFrame([(1, "the cat sat", "en"), (1, "le chat est assis la", "fr"), (1, "x", None), (2, "longer than", "en"), (2, "short", "en")], "doc_id long, text string, lang string")
    got = common.training_sample(df, language_id.learnable(df.withColumn("doc_id", F.col("doc_id"))), "lang", 10, 10_000, own=True)
    want = {(t, k) for i, t, k in [(1, "the cat sat", "en"), (1, "le chat est assis la", "fr"), (2, "short", "en")] if df.where(f"doc_id = {i} and pmod(crc32(cast(doc_id as string)), 4) != 2").count()}
    assert set(got) == want and len(got) == len(want) >= 1
