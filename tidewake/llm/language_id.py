"""Language of a text by a bidirectional gated recurrent network over its bytes.

Two recurrent layers read a window of bytes from either end; at every byte both states
together give a distribution over the languages, and a document's probabilities are
the mean over all its bytes. Everything is numpy: training is backpropagation through
time with Adam, on random windows of a bounded sample of documents.

Training takes whole texts of at most SAMPLE documents of each language, those whose ids
have the smallest hashes, and at most TRAIN_BYTES in all. Prediction reads every text whole, in windows
of WINDOW bytes that are laid side by side, BATCH at a time, so memory doesn't depend
on how long a text is (but for the text itself).

Defined results: a row without doc_id counts as held out, as nothing is learned from it; `und` and a score of 0 for a text that is null or has no letter, and for
every text if no language was learned; equal rows get equal results; ties go to the
language that sorts first; an empty table gives an empty table; other columns play no
part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, small_batches, table, tidily, training_sample, with_ids
from .hashing import LOWER, blocks

SAMPLE, TRAIN_BYTES = 250, 8_000_000
HIDDEN, WINDOW, BATCH = 10, 128, 1024
ROUNDS, TRAIN_WINDOW, TRAIN_BATCH = 400, 48, 192
#: Letters, and numbers that aren't digits, which isalpha tells apart.
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
_f = np.float32


def folded(data: bytes) -> np.ndarray:
    """Bytes with ASCII letters and the two-byte letters of Latin-1 in lower case."""
    b = LOWER[np.frombuffer(data, np.uint8)]
    after = np.zeros(len(b), bool)
    after[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
    b[after] += 0x20
    return b


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def states(rows: np.ndarray, active: list[int], order: range, table_: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The state after each byte, (steps, batch, hidden); at step t the first active[t] rows go on, the others' states are 0."""
    steps, batch, hidden = rows.shape[0], rows.shape[1], u.shape[0]
    out, h = np.zeros((steps, batch, hidden), _f), np.zeros((batch, hidden), _f)
    for t in order:
        n = active[t]
        if not n:
            continue
        before = h[:n]
        x, g = table_[rows[t, :n]], before @ u
        zr = sigmoid(x[:, : 2 * hidden] + g[:, : 2 * hidden])
        z, r = zr[:, :hidden], zr[:, hidden:]
        new = x[:, 2 * hidden :] + r * g[:, 2 * hidden :]
        new = 2 * sigmoid(2 * new) - 1
        if keep is not None:
            keep.append((t, before.copy(), z, r, new, g[:, 2 * hidden :]))
        h[:n] = new + z * (before - new)
        out[t, :n] = h[:n]
    return out


def gradients(rows: np.ndarray, d: np.ndarray, table_: np.ndarray, u: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time: of the input table and the recurrent weights, for d of the states."""
    hidden = u.shape[0]
    dx, du, dh = np.zeros((rows.size, 3 * hidden), _f), np.zeros_like(u), np.zeros(d.shape[1:], _f)
    batch = rows.shape[1]
    for t, before, z, r, new, gn in reversed(keep):
        dh = dh + d[t]
        dn = dh * (1 - z) * (1 - new * new)
        dz = dh * (before - new) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        back = np.concatenate([dz, dr, dn * r], 1)
        du += before.T @ back
        dx[t * batch : (t + 1) * batch] = np.concatenate([dz, dr, dn], 1)
        dh = dh * z + back @ u.T
    hot = np.zeros((rows.size, 256), _f)
    hot[np.arange(rows.size), rows.ravel()] = 1
    return hot.T @ dx, du


@dataclass
class Model:
    """Input tables, recurrent weights (forward, backward), output weights and bias."""

    languages: list[str]
    weights: list[np.ndarray]

    def positions(self, rows: np.ndarray, active: list[int]) -> np.ndarray:
        """Probabilities at every byte of a batch, (steps, batch, languages)."""
        tf, uf, tb, ub, v, c = self.weights
        steps = rows.shape[0]
        f = states(rows, active, range(steps), tf, uf)
        b = states(rows, active, range(steps - 1, -1, -1), tb, ub)
        logits = f @ v[: f.shape[2]] + b @ v[f.shape[2] :] + c
        logits -= logits.max(2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(2, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """The mean of the bytes' probabilities of each text; zeros for an empty one."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.array([len(t) for t in texts])
        buf = folded(b"".join(texts))
        first = np.cumsum(sizes) - sizes
        counts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = first[owner] + nth * WINDOW
        length = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
        by = np.argsort(-length, kind="stable")
        for k in range(0, len(by), BATCH):
            w = by[k : k + BATCH]
            n = length[w]
            steps = int(n[0])
            at = np.minimum(start[w] + np.arange(steps)[:, None], len(buf) - 1)
            active = np.searchsorted(-n, -np.arange(steps), side="left").tolist()
            p = self.positions(buf[at], active)
            p[np.arange(steps)[:, None] >= n] = 0
            np.add.at(sums, owner[w], p.sum(0, dtype=np.float64))
        return sums / np.maximum(sizes, 1)[:, None]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        letters = [any(m[0].isalpha() for m in LETTER.finditer(t.decode("utf-8", "surrogatepass"))) for t in texts]
        p = self.pooled(texts)
        best = p.argmax(1)
        return [(self.languages[k], min(1.0, float(row[k]))) if ok else (UNKNOWN, 0.0) for k, row, ok in zip(best.tolist(), p, letters)]


def train(texts: list[str], langs: list[str], rounds: int = ROUNDS, hidden: int = HIDDEN, seed: int = 0) -> Model:
    languages = sorted(set(langs))
    data = [folded(t.encode("utf-8", "surrogatepass")) for t in texts]
    of = {k: [d for d, x in zip(data, langs) if x == k and len(d) >= 8] for k in languages}
    languages = [k for k in languages if of[k]]
    rng, k = np.random.default_rng(seed), len(languages)
    if not k:
        return Model([], [])
    make = lambda *shape: (rng.normal(size=shape) * 0.3).astype(_f)
    weights = [make(256, 3 * hidden), make(hidden, 3 * hidden), make(256, 3 * hidden), make(hidden, 3 * hidden), make(2 * hidden, k), np.zeros(k, _f)]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        label = rng.integers(0, k, TRAIN_BATCH)
        rows = np.empty((TRAIN_WINDOW, TRAIN_BATCH), np.uint8)
        for i, y in enumerate(label):
            d = of[languages[y]][rng.integers(len(of[languages[y]]))]
            at = rng.integers(0, max(1, len(d) - TRAIN_WINDOW + 1))
            rows[:, i] = np.resize(d[at : at + TRAIN_WINDOW], TRAIN_WINDOW)
        tf, uf, tb, ub, v, c = weights
        all_, keep_f, keep_b = [TRAIN_BATCH] * TRAIN_WINDOW, [], []
        f = states(rows, all_, range(TRAIN_WINDOW), tf, uf, keep_f)
        b = states(rows, all_, range(TRAIN_WINDOW - 1, -1, -1), tb, ub, keep_b)
        both = np.concatenate([f, b], 2)
        logits = both @ v + c
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(TRAIN_BATCH), label] -= 1
        d = (p / p[..., 0].size).astype(_f)
        ds = d @ v.T
        gf, guf = gradients(rows, ds[..., :hidden], tf, uf, keep_f)
        gb, gub = gradients(rows, ds[..., hidden:], tb, ub, keep_b)
        grads = [gf, guf, gb, gub, both.reshape(-1, 2 * hidden).T @ d.reshape(-1, k), d.sum((0, 1))]
        rate = 0.03 * (1 - step / (rounds + 1)) + 0.002
        for i, g in enumerate(grads):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.99 * m2[i] + 0.01 * g * g
            weights[i] = (weights[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.99**step)) + 1e-8)).astype(_f)
    return Model(languages, weights)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and pmod(crc32(cast(doc_id as string)), 4) != 2").select("doc_id", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_sample(docs, learnable(docs), "lang", sample, TRAIN_BYTES, own=True)
    model = train([t for t, _ in rows], [lang for _, lang in rows])
    del rows
    give_back()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [x for _, texts in blocks(pdf["text"]) for x in held.value.predict(texts)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})

    return with_ids(docs.select("doc_id", "text"), tidily(run), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
