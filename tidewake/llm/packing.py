"""Best-fit packing by minimum bin slack.

Every document becomes token ids and an end id; longer ones than a sequence are cut into
pieces. How many pieces there are of each length (at most CAPACITY numbers, whatever the
input) decides the packing: for each sequence the longest piece left is set, and a
bitset of reachable sums over the lengths left (bit s is set if some of them make s)
gives the fullest combination with it, which is then removed, as often as the
numbers allow at once. Pieces of one length are interchangeable: each gets a rank
among its length, and its rank tells its sequence and offset.

Defined results: a null or empty text is one piece that holds the end id alone; equal
rows are packed each for itself, and so are rows with a null doc_id; which of the pieces
of one length takes which place is decided by a hash, then by doc_id, piece and crc; a
very long text is encoded whole and gives as many pieces as it needs; an empty table
gives an empty table; other columns play no part. Ids do not depend on how rows are
batched: words that were encoded before are told apart by their bytes.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing
from .common import STAGE_ROWS, small_batches, table, tidily, with_ids, written

CAPACITY, END_ID = 4096, 1
#: The pieces of one length are ranked in parts of about this many.
PART_ROWS, LEAST_PARTS = 50_000, 128
TOKENIZER = "word_bpe_49k.json"
#: Words and chunks remembered by each worker at a time; only speed depends on it.
REMEMBERED, REMEMBERED_BYTES, CHUNKS = 300_000, 16_000_000, 50_000
SPACE, LETTER, DIGIT, OTHER = range(4)


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind)


#: Texts that are cut by classes of their bytes: ASCII without apostrophes, and the two-byte letters of Latin-1.
BY_BYTES = re.compile(r"[\x00-\x1b\x20-&(-\x7fÀ-ÖØ-öø-ÿ]*")
#: Of the rest, texts that are cut at white space first; all others go to the tokenizer whole.
PLAIN = re.compile(r"[\x00-\x1b\x20-įı-ſ]*")
#: The tokenizer's own way of cutting text between white space.
CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{_class('L')}{_class('N')}]+")
CLASS = np.full(256, OTHER, np.int8)
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
CLASS[0x30:0x3A] = DIGIT


def alike(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of one span of each kind, kind of each span): spans of the same bytes are of one kind.

    Hashes propose the kinds, their bytes confirm them.
    """
    eight = hashing.pieces(buf)
    _, where, back = np.unique(hashing.spans(buf, start, end, eight), return_index=True, return_inverse=True)
    other = np.flatnonzero(~hashing.equal(buf, start, end, where[back], eight))
    if len(other):  # hashes collide: each of these is a kind of its own
        back[other] = len(where) + np.arange(len(other))
        where = np.r_[where, other]
    return where, back


class Encoder:
    """Ids (unsigned, 32 bits, little-endian) of texts; what was cut before is not encoded again."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.chunks: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # a word to its number
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)  # by number: where in the pool
        self.pool, self.used, self.held = np.zeros(1 << 18, np.uint32), 0, 0  # held: bytes of words

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def of_words(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each word's end) of words that the tokenizer doesn't cut."""
        ids = self.whole(" ".join(some))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(some):
            raise ValueError("the tokenizer cuts text in another way")
        return ids, stops

    def learn(self, some: list[bytes]) -> None:
        """Put new words into the pool."""
        for k in range(0, len(some), 4_000):
            ids, stops = self.of_words([w.decode() for w in some[k : k + 4_000]])
            n, m = len(self.known), len(stops)
            while len(self.pool) < self.used + len(ids):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while len(self.first) < n + m:
                self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
            self.pool[self.used : self.used + len(ids)] = ids
            begin = np.r_[0, stops[:-1]]
            self.first[n : n + m], self.size[n : n + m] = self.used + begin, stops - begin
            self.used += len(ids)
            self.held += sum(map(len, some[k : k + 4_000]))
            self.known.update(zip(some[k : k + 4_000], range(n, n + m)))

    def by_bytes(self, texts: list[bytes]) -> list[bytes]:
        """Ids of lower-case texts that BY_BYTES admits."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        kind = CLASS[buf]
        turn = np.ones(len(buf), bool)
        turn[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(turn)
        use = kind[at] != SPACE
        start, end = at[use], np.r_[at[1:], len(buf)][use]
        where, back = alike(buf, start, end)
        data, a, b = buf.tobytes(), start[where].tolist(), end[where].tolist()
        names = [data[i:j] for i, j in zip(a, b)]
        self.learn(list(dict.fromkeys(w for w in names if w not in self.known)))
        numbers = [self.known[w] for w in names]
        word = np.array(numbers, np.int64)[back]
        size = self.size[word]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.pool[np.repeat(self.first[word] - (stop - size), size) + np.arange(total)].astype("<u4")
        cuts = np.r_[0, stop][np.searchsorted(start, hashing.offsets(texts))].tolist()
        return [ids[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]

    def by_chunks(self, text: str) -> bytes:
        """Ids of a text that PLAIN admits."""
        chunks = text.lower().split()
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        new = list(set(chunks).difference(self.chunks))
        cut = [CUT.findall(c) for c in new]
        some = sorted({p for ps in cut for p in ps})
        if some:
            ids, stops = self.of_words(some)
            data = ids.astype("<u4").tobytes()
            parts = dict(zip(some, (data[4 * a : 4 * b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist()))))
            self.chunks.update(zip(new, [b"".join([parts[p] for p in ps]) for ps in cut]))
        return b"".join([self.chunks[c] for c in chunks])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Of each text as the tokenizer's encode(text, add_special_tokens=False)."""
        plain = [t if "<|" not in (t or "") and BY_BYTES.fullmatch(t or "") else None for t in texts]
        for first, block in hashing.blocks(t and t.lower() for t in plain):
            for k, ids in enumerate(self.by_bytes(block), first):
                text = texts[k] or ""
                if plain[k] is not None or not text:
                    yield ids
                elif "<|" in text or not PLAIN.fullmatch(text):
                    yield self.whole(text).astype("<u4").tobytes()
                else:
                    yield self.by_chunks(text)


@cache
def encoder_for(path: str | None) -> Encoder:
    """One for each worker process, so that tasks find what earlier ones learned."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, step = encoder_for(tokenizer), np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encoder.encode(pdf["text"].tolist())):
                ids += end
                rows += [(doc_id, k, at // 4, len(part := ids[at : at + step]) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), step))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_ids(docs.select("doc_id", "text"), tidily(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum up to room; lengths: falling, those to be tried."""
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for size in lengths:
        most = min(counts[size], room // size) if size <= room else 0
        if not most:
            continue
        stages.append((size, most, reach))
        step = 1
        while most:  # copies in powers of two
            take = min(step, most)
            reach |= reach << (size * take) & mask
            most -= take
            step *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, most, before in reversed(stages):
        copies = 0
        while not before >> at & 1:
            at -= size
            copies += 1
        if copies:
            out[size] = copies
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how often, {length: how many}) of the sequences."""
    counts = {k: v for k, v in histogram.items() if v}
    out = []
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        found = fullest(counts, lengths, capacity - first)
        counts[first] += 1
        found[first] = found.get(first, 0) + 1
        times = min(counts[size] // n for size, n in found.items())
        out.append((times, found))
        for size, n in found.items():
            counts[size] -= n * times
            if not counts[size]:
                del counts[size]
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = written(pieces(docs, capacity, tokenizer), "pieces")
    parts = max(LEAST_PARTS, cut.count() // PART_ROWS)
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    keys, seqs, offsets, used, sequence = [], [], [], dict.fromkeys(histogram, 0), 0
    for times, found in plan(histogram, capacity):
        offset = 0
        for size, n in sorted(found.items(), reverse=True):
            for _ in range(n):
                keys.append(size << 40 | used[size])
                seqs.append(sequence)
                offsets.append(offset)
                used[size] += times
                offset += size
        sequence += times
    by = np.argsort(np.array(keys, np.int64))
    placed = spark.sparkContext.broadcast((np.array(keys, np.int64)[by], np.array(seqs, np.int64)[by], np.array(offsets, np.int64)[by]))

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, seqs, offsets = placed.value
        for pdf in batches:
            key = pdf["length"].to_numpy(np.int64) << 40 | pdf["rank"].to_numpy(np.int64)
            k = np.searchsorted(keys, key, side="right") - 1
            yield pdf.drop(columns="rank").assign(sequence_id=seqs[k] + key - keys[k], offset=offsets[k])

    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("place", F.row_number().over(order) - 1).join(first, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))
    return with_ids(ranked, locate, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of docs."""
    small_batches(spark, STAGE_ROWS)
    return pack(docs)
