"""Toxic spans by a linear-chain conditional random field.

Labels are known for documents only, so tokens are labelled first: features of words
(the word itself and its first 4, 5 and 6 bytes) that are significantly more frequent
in toxic training texts mark their tokens in those texts. On these tokens a chain of
two labels is trained by gradients from forward-backward. A logistic regression over
what the marginals of a text add up to gives the document's score.

Training takes at most SAMPLE labelled texts of either label, whole, those whose ids have
the smallest hashes, and at most TRAIN_BYTES in all; that is all the driver holds. Near
copies of one label count as one text together. The chain learns from windows around every such word of toxic
and of clean texts, and from one more window of each clean text. Scoring reads every text whole. Words without a known feature all
have one emission, so runs of them are powers of one 2 x 2 matrix, and forward-backward
is exact at the cost of the other words.

Defined results: a row without doc_id counts as held out, as nothing is learned from it; a null or empty text scores as a text without toxic words; without
labelled rows of both kinds every score is 0; a document with several labels counts as
toxic if one of them says so; repeated rows each get their own equal row; an empty
table gives an empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DIGEST, STAGE_ROWS, digested, give_back, small_batches, table, tidily, training_sample, with_ids, without
from .hashing import LETTERS, blocks, mix, shingle_sets, words
from . import hashing

SAMPLE, TRAIN_BYTES = 2_000, 12_000_000
SIGNIFICANT = 16.0
#: Similarity from which on texts of one label are copies of each other in training.
SIMILAR = 0.5
PREFIXES = (4, 5, 6)
SPAN = 20
_U = np.uint64


def features(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of each feature kind, start, end, first): as hashing.words; a prefix no shorter than its word has the hash 0."""
    h, start, end, first, buf = words(texts, LETTERS)
    head = hashing.pieces(buf)[start]
    out = [h]
    for n in PREFIXES:
        p = mix((head & hashing.FIRST[n]) ^ _U((1 << 60) + n))
        out.append(np.where(end - start > n, p, _U(0)))
    return out, start, end, first


@dataclass
class Model:
    """The chain over labels 0 and 1, and the regression on top."""

    known: np.ndarray = field(default_factory=lambda: np.empty(0, _U))  # sorted feature hashes
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = -5.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    top: np.ndarray | None = None  # of (1, max, log sum, density); None: nothing was learned
    gate: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.known >> _U(48)).astype(np.int64)] = True

    def find(self, kinds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature number) of every known feature."""
        at, ids = [], []
        for h in kinds:
            i = np.flatnonzero(self.gate[(h >> _U(48)).astype(np.int64)])
            if len(i):
                k = np.minimum(np.searchsorted(self.known, h[i]), len(self.known) - 1)
                ok = self.known[k] == h[i]
                at.append(i[ok])
                ids.append(k[ok])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(ids)

    def marginals(self, place: np.ndarray, emission: np.ndarray, n: int) -> np.ndarray:
        """P(label 1) of the tokens at place (rising) with these emissions; the other n - len(place) have the bias alone."""
        step = np.exp(self.trans)
        plain = step * np.array([1.0, np.exp(self.bias)])
        values, vectors = np.linalg.eig(plain)
        top = values.real.max()
        ratio, left = values.real / top, np.linalg.inv(vectors.real)
        def power(g: int) -> np.ndarray:
            return (vectors.real * ratio**g) @ left

        m = len(place)
        gap = np.diff(np.r_[-1, place]) - 1
        ahead = np.empty((m, 2))
        a = np.array([1.0, 1.0])
        for i in range(m):
            own = np.array([1.0, np.exp(min(emission[i], 50.0))])
            if gap[i]:  # the first token has no transition into it
                a = a * (np.array([1.0, np.exp(self.bias)]) if i == 0 else 1.0)
                a = a @ power(int(gap[i]) - (i == 0))
            a = (a @ step if i or gap[i] else a) * own
            a /= a.sum()
            ahead[i] = a
        b, out = np.ones(2), np.empty(m)
        rest = n - 1 - place[-1] if m else 0
        b = power(int(rest)) @ b
        for i in range(m - 1, -1, -1):
            p = ahead[i] * b
            out[i] = p[1] / p.sum()
            own = np.array([1.0, np.exp(min(emission[i], 50.0))])
            b = step @ (own * b)
            b = power(int(gap[i])) @ b
            b /= b.sum()
        return out

    def of_block(self, texts: list[bytes]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """(score, spans in bytes with their marginals) of each text."""
        if self.top is None:
            return [(0.0, [])] * len(texts)
        kinds, start, end, first = features(texts)
        at, ids = self.find(kinds)
        token, back = np.unique(at, return_inverse=True)
        emission = self.bias + np.bincount(back, self.weight[ids], len(token)) if len(token) else np.empty(0)
        cut = np.searchsorted(token, first)
        base, out = 0, []
        for i, text in enumerate(texts):
            n, a, b = int(first[i + 1] - first[i]), cut[i], cut[i + 1]
            p = self.marginals(token[a:b] - first[i], emission[a:b], n) if b > a else np.empty(0)
            out.append((self.score(p, n), [(int(start[t] - base), int(end[t] - base), float(x)) for t, x in zip(token[a:b], p) if x >= 0.5]))
            base += len(text) + 1
        return out

    def summary(self, p: np.ndarray, n: int) -> np.ndarray:
        total = p.sum()
        return np.array([1.0, p.max(initial=0.0), np.log1p(total), np.log1p(total) / np.log(n + 3.0)])

    def score(self, p: np.ndarray, n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.summary(p, n) @ self.top, -30, 30))))


def significance(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of counts (features x labels) against what the totals expect; negative where toxic is the rarer."""
    expected = n.sum(1, keepdims=True) * (total / total.sum())
    ratio = (n * np.log(np.maximum(n, 1e-9) / expected)).sum(1)
    return np.where(n[:, 1] > expected[:, 1], ratio, -ratio)


def forward_backward(emission: np.ndarray, mask: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1, and expected transitions, of a batch of padded sequences; weight: what each counts among the transitions."""
    rows, steps = emission.shape
    e = np.stack([np.ones_like(emission), np.exp(np.clip(emission, -30, 30))], 2)
    t = np.exp(trans)
    a = np.empty((rows, steps, 2))
    a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for k in range(1, steps):
        x = (a[:, k - 1] @ t) * e[:, k]
        a[:, k] = np.where(mask[:, k, None], x / x.sum(1, keepdims=True), a[:, k - 1])
    b = np.ones((rows, 2))
    p, expected = np.empty((rows, steps)), np.zeros((2, 2))
    for k in range(steps - 1, -1, -1):
        m = a[:, k] * b
        p[:, k] = np.where(mask[:, k], m[:, 1] / m.sum(1), 0.0)
        if k:
            nb = e[:, k] * b
            x = a[:, k - 1, :, None] * t * nb[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            expected += x[mask[:, k]].sum(0) if weight is None else np.tensordot(weight[mask[:, k]], x[mask[:, k]], 1)
            y = nb @ t.T
            b = np.where(mask[:, k, None], y / y.sum(1, keepdims=True), b)
    return p, expected


def shares(texts: list[bytes]) -> np.ndarray:
    """What each text counts: one over the number of its near copies, itself included, so that copies don't make their words look significant.

    Texts that share one of their four smallest shingles with an earlier text, and SIMILAR of all shingles, are copies of that one.
    """
    sets, leaders, of = [frozenset(s.tolist()) for s in shingle_sets(texts)], {}, []
    for i, s in enumerate(sets):
        first = sorted(s)[:4]
        near = {j for x in first for j in leaders.get(x, ()) if len(s & sets[j]) >= SIMILAR * len(s | sets[j])}
        of.append(min(near, default=i))
        if of[i] == i:
            for x in first:
                leaders.setdefault(x, []).append(i)
    return 1 / np.bincount(of, minlength=len(of))[of] if of else np.zeros(0)


def train(texts: list[str], labels: np.ndarray, rounds: int = 60, seed: int = 0) -> Model:
    """The model from whole documents with labels 0 and 1."""
    if len(set(labels.tolist())) < 2:
        return Model()
    kept = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    y = np.asarray(labels)
    share = np.zeros(len(kept))
    for label in (0, 1):
        share[y == label] = shares([kept[i] for i in np.flatnonzero(y == label)])
    parts = [(kinds, int(first[-1])) for kinds, _, _, first in (features([t]) for t in kept)]
    words_of = [np.unique(np.concatenate(kinds)) for kinds, _ in parts]
    toxic_words = np.concatenate([words_of[i] for i in np.flatnonzero(y == 1)])
    names, back = np.unique(toxic_words, return_inverse=True)
    toxic = np.bincount(back, np.concatenate([np.full(len(words_of[i]), share[i]) for i in np.flatnonzero(y == 1)]), len(names))
    names, toxic = names[use := (toxic >= 3 - 1e-6) & (names != 0)], toxic[use]
    if not len(names):
        return Model()
    clean = np.zeros(len(names))
    for i in np.flatnonzero(y == 0):
        at = np.minimum(np.searchsorted(names, words_of[i]), len(names) - 1)
        clean[at[names[at] == words_of[i]]] += share[i]
    n = np.stack([clean, toxic], 1)
    names = names[significance(n, np.array([share[y == 0].sum(), share[y == 1].sum()])) >= SIGNIFICANT]
    model = Model(names, np.zeros(len(names)))
    rng = np.random.default_rng(seed)
    width = 2 * SPAN + 1
    places, gold, lengths, weight = [], [], [], []
    for (kinds, size), label, own in zip(parts, y.tolist(), share.tolist()):
        at, ids = model.find(kinds)
        hit = np.unique(at)
        centre = hit if label else np.sort(np.r_[hit, rng.integers(0, max(size, 1), 1)])
        lo = 0
        for c in centre.tolist():
            lo = max(lo, c - SPAN)
            hi = min(size, c + SPAN + 1)
            if hi <= lo:
                continue
            row = len(places)
            inside = (at >= lo) & (at < hi)
            drop_word = rng.random() < 0.3  # so that prefixes are learned too
            word = np.arange(len(at)) < np.isin(kinds[0], names).sum()
            use = inside & ~(word & drop_word)
            places.append((np.full(use.sum(), row), at[use] - lo, ids[use]))
            gold.append([(row, t - lo) for t in hit[(hit >= lo) & (hit < hi)].tolist()] if label else [])
            lengths.append(hi - lo)
            weight.append(own)
            lo = hi
    if not places or not any(gold):
        return Model()
    rows = len(lengths)
    r, c, f = (np.concatenate(x) for x in zip(*places))
    mask, weight = np.arange(width) < np.array(lengths)[:, None], np.array(weight)
    truth = np.zeros((rows, width))
    for g in gold:
        for i, j in g:
            truth[i, j] = 1
    seen_trans = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen_trans[i, j] = weight @ ((truth[:, :-1] == i) & (truth[:, 1:] == j) & mask[:, 1:]).sum(1)
    theta = np.r_[np.zeros(len(names)), -3.0, np.zeros(4)]
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        emission = np.full((rows, width), theta[len(names)])
        emission += np.bincount(r * width + c, theta[f], rows * width).reshape(rows, width)
        p, expected = forward_backward(emission, mask, theta[-4:].reshape(2, 2), weight)
        error = (p - truth) * mask * weight[:, None]
        grad = np.r_[np.bincount(f, error[r, c], len(names)), error.sum(), (expected - seen_trans).ravel()]
        grad = grad + 0.05 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta - 0.25 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    model = Model(names, theta[: len(names)], float(theta[len(names)]), theta[-4:].reshape(2, 2))
    x = []
    for kinds, size in parts:
        at, ids = model.find(kinds)
        token, back = np.unique(at, return_inverse=True)
        emission = model.bias + np.bincount(back, model.weight[ids], len(token)) if len(token) else np.empty(0)
        x.append(model.summary(model.marginals(token, emission, size) if len(token) else np.empty(0), size))
    x, w = np.array(x), np.zeros(4)
    for _ in range(50):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(4)
        w = w - np.linalg.solve(h, x.T @ (share * (q - y)) + 0.1 * w)
    model.top = w
    return model


def learnable(labels: DataFrame) -> DataFrame:
    known = labels.where("toxic is not null and doc_id is not null and pmod(crc32(cast(doc_id as string)), 5) != 0")
    return known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_sample(docs, learnable(labels), "toxic", sample, TRAIN_BYTES)
    model = train([t for t, _ in rows], np.array([y for _, y in rows], np.int64))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, score, spans, keep): spans of toxic words in code points, with their marginals; keep: string columns of docs."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = held.value
        for pdf in batches:
            scores, spans = [], []
            for _, texts in blocks(pdf["text"]):
                for text, (s, found) in zip(texts, own.of_block(texts)):
                    scores.append(s)
                    out, at, chars = [], 0, 0
                    for a, b, p in found:
                        chars += len(text[at:a].decode("utf-8", "surrogatepass"))
                        n = len(text[a:b].decode("utf-8", "surrogatepass"))
                        out.append({"start": chars, "end": chars + n, "p": p})
                        chars, at = chars + n, b
                    spans.append(out)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": scores, "spans": spans} | {c: pdf[c] for c in keep})

    schema = "doc_id long, score double, spans array<struct<start:long,end:long,p:double>>" + "".join(f", {c} string" for c in keep)
    return with_ids(docs.select("doc_id", "text", *keep), tidily(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose text the model finds toxic, whatever their doc_id."""
    small_batches(spark, STAGE_ROWS)
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return without(docs, score(digested(docs), model, [DIGEST]).where("score >= 0.5").select("doc_id", DIGEST))
