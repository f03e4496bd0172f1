"""The chain against brute force, and accuracy on rows it didn't learn from."""

import itertools
import re

import numpy as np

from tidewake.llm import toxicity
from tidewake.llm.toxicity import F


def test_marginals_are_those_of_the_whole_chain():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 8):
        for m in range(n + 1):
            place = np.sort(rng.choice(n, m, False))
            model = toxicity.Model(bias=-1.2, trans=rng.normal(size=(2, 2)))
            e = np.full(n, model.bias)
            own = rng.normal(size=m) * 3
            e[place] = own
            total, ones = 0.0, np.zeros(n)
            for y in itertools.product((0, 1), repeat=n):
                w = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(model.trans[a, b] for a, b in zip(y, y[1:])))
                total += w
                ones += w * np.array(y)
            if m:
                assert np.allclose(model.marginals(place, own, n), (ones / total)[place])
            p, _ = toxicity.forward_backward(e[None], np.ones((1, n), bool), model.trans)
            assert np.allclose(p[0], ones / total)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("toxic", "predicted", "score").toPandas()
    hit = (got.toxic == got.predicted).mean()
    caught = got[got.toxic == 1].predicted.mean()
    clean = (got[got.toxic == 0].predicted == 0).mean()
    assert len(got) > 500 and hit > 0.97 and caught > 0.85 and clean > 0.99, (hit, caught, clean)


def test_spans_are_code_points_of_words(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = [None, "", "été ñandú idiot scum 😀 moron.", "The and of", "x" * 200_000, "idiot " * 5_000]
    df = spark.createDataFrame([(i, t, "?") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert [texts[2][s["start"] : s["end"]] for s in got[2]["spans"]] == ["idiot", "scum", "moron"]
    assert len(got[5]["spans"]) == 5_000 and got[5]["score"] > 0.5
    assert got[0]["score"] == got[1]["score"] < 0.5 and got[3]["score"] < 0.5
    assert toxicity.score(df.limit(0), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame([(1, "idiot"), (1, "idiot"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r["score"] for r in toxicity.score(docs, model).collect()] == [0.0] * 3


def test_near_copies_do_not_teach_words():
    base = "one two three four five six seven eight nine ten zebra"
    texts = [base + f" idiot n{i}" for i in range(30)] + [f"plain words number {i} of text {i * 7} here" for i in range(100)] + [f"k{i} l{i} m{i} n{i} o{i} idiot p{i}" for i in range(30)]
    model = toxicity.train(texts, np.array([1] * 30 + [0] * 100 + [1] * 30))
    out = model.of_block([b"a zebra here", b"an idiot here"])
    assert out[0][0] < 0.5 < out[1][0] and not out[0][1]
    assert re.fullmatch("idiot", "an idiot here"[out[1][1][0][0] : out[1][1][0][1]])


def test_minimal_pairs_are_told_apart():
    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(300)]
    clean = [" ".join(rng.choice(vocab, 40)) for _ in range(200)]
    toxic = [f"{t} you are vile scum" for t in clean]
    model = toxicity.train(clean + toxic, np.array([0] * 200 + [1] * 200))
    scores = [s for s, _ in model.of_block([t.encode() for t in clean + toxic])]
    assert max(scores[:200]) < 0.5 < min(scores[200:])


def test_copies_of_one_label_share_one_text():
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    texts = [a, a + " end", b, a, "", "", f"{b} c d e f g"]
    got = toxicity.shares([t.encode() for t in texts])
    assert np.allclose(got, [1 / 3, 1 / 3, 1 / 2, 1 / 3, 1, 1, 1 / 2])
    boiler = [f"one two three four five six {x} {x}{x} {x}y {x}z {x}u {x}v {x}w" for x in "abcdefgh"]
    assert np.allclose(toxicity.shares([t.encode() for t in boiler]), 1)


def test_boilerplate_drops_no_text():
    rng = np.random.default_rng(4)
    text = lambda: "a a a a a a a a " + " ".join(rng.choice([f"w{i}" for i in range(200)], 50))
    clean, toxic = [text() for _ in range(60)], [text() + " vile" for _ in range(60)]
    model = toxicity.train(clean + toxic, np.array([0] * 60 + [1] * 60))
    assert [s >= 0.5 for s, _ in model.of_block([b"this is vile", b"this is fine"])] == [True, False]
