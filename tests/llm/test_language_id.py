"""Gradients against differences, windows against whole runs, held-out accuracy."""

import numpy as np

from tidewake.llm import language_id as L


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 5, (6, 3)).astype(np.uint8)
    t, u, d = (rng.normal(size=s) for s in ((256, 12), (4, 12), (6, 3, 4)))
    L._f, saved = np.float64, L._f
    try:
        for order in (range(6), range(5, -1, -1)):
            loss = lambda: float((L.states(rows, [3] * 6, order, t, u) * d).sum())
            keep: list = []
            L.states(rows, [3] * 6, order, t, u, keep)
            gt, gu = L.gradients(rows, d, t, u, keep)
            for w, g, places in ((t, gt, [(0, 0), (3, 5), (4, 11)]), (u, gu, [(0, 0), (2, 7), (3, 11)])):
                for p in places:
                    w[p] += 1e-5
                    up = loss()
                    w[p] -= 2e-5
                    down = loss()
                    w[p] += 1e-5
                    assert abs((up - down) / 2e-5 - g[p]) < 1e-5
    finally:
        L._f = saved


def model():
    en, fr = "the cat and this dog with their long walk home", "le chat et ce chien avec une longue été à côté"
    return L.train([en] * 3 + [fr] * 3, ["en"] * 3 + ["fr"] * 3, rounds=120)


def test_batches_do_not_change_results():
    m = model()
    texts = [b"the cat", b"", b"with their " * 700, "été à côté".encode(), b"x"] * 40
    alone = np.concatenate([m.pooled([t]) for t in texts])
    assert np.allclose(m.pooled(texts), alone, atol=1e-5)


def test_predictions_and_unknown():
    m = model()
    got = m.predict(["WITH THE DOG".encode(), "AVEC LE CHIEN ÉTÉ".encode(), b"", "12 ++ 34 ² ½ _".encode(), b"the " * 60_000])
    assert [g[0] for g in got] == ["en", "fr", "und", "und", "en"]
    assert got[2][1] == 0.0 and all(0 <= g[1] <= 1 for g in got)
    assert L.train([], []).predict([b"abc"]) == [("und", 0.0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = L.query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) > 2_000 and (got.lang == got.lang_pred).mean() > 0.97


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "en", 2.0), (1, None, None, 2.0), (3, "the dog", "en", 1.0), (3, "the dog", "en", 1.0), (None, "le chien", None, 0.0)], "doc_id long, text string, lang string, score double")
    out = L.predict(df, model()).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in out) == [(0, "fr"), (1, "und"), (1, "und"), (3, "en"), (3, "en")]
    assert L.predict(df, L.fit(df.limit(0))).count() == 5 and L.predict(df.limit(0), model()).count() == 0
