"""N-gram Jaccard join by a prefix tree over globally ordered shingle sets.

A document's set holds its five-word shingles as 64-bit tokens whose integer order is
the global order: the upper LEVEL_BITS are a level of frequency, from a sketch over every
shingle of every document, so that frequent shingles come last; the rest is the shingle's
hash. The sketch has a counter for every PER_CELL shingles (MOST_CELLS at most). Documents
with equal sets, by a name of 128 bits, form one class and are joined as one.

1. Candidates. Two sets that reach the threshold share a token among the first
   n - ceil(0.75 n) + 1 of each. These tokens meet by hash, and for each pair the tokens
   that both prefixes share are counted; a pair is kept only if they and what remains
   of the sets behind their prefixes can reach the needed overlap. A token of more
   than HOT classes isn't paired up: its classes are listed under a leader.
2. Verification. The candidates of one leader are stored in a trie, in which sets that
   begin alike share a path. The leader walks down it: the overlap counted along a path
   serves all sets below, and a subtree is left as soon as no size in it can reach the
   needed overlap with the tokens that remain on both sides. Of the
   leaders under which a class is listed the first is tried at once, the others only if they
   are in another component then.
3. Components of the links by alternating stars. A class under a leader that is not in
   its leader's component then walks down the trie of all classes under that leader,
   where subtrees of its own component are left at once, and links found join the
   components. So no link between components is lost, and no pair list of a large group
   is made. The sets under a leader are dealt to tries of about TRIE_TOKENS tokens. Before
   texts are sent to these tries, signatures of two bits for each token, whose differences
   bound the overlap from above, leave out the sets that can't link with any other there.

Candidates name a class by half of its 128 bits; texts are looked up by that half and
carry the whole name from there on, so two sets of one half are compared as two.

Defined results: a null or blank text has an empty set, links with nothing and is its
own component; equal rows and equal texts are one class; a null doc_id is never the
smallest; an empty table gives an empty table; other columns play no part. Memory: a
task holds one partition of tokens or one trie of about TRIE_TOKENS tokens (LEAST_SETS
sets, if they have more); a single text as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import DIGEST, STAGE_ROWS, digested, give_back, partitions, small_batches, table, tidily, with_ids, without, written
from .hashing import blocks, mix, shingle_sets

#: 7 * overlap >= 3 * (sum of sizes) is a similarity of 0.75.
PER_CELL, LEAST_CELLS, MOST_CELLS, SLICE = 32, 1 << 22, 1 << 23, 1 << 12
BITS = 1 << 27
LEVEL_BITS = 6
#: Tokens of the sets in one trie, and how many sets it holds at least, if there are as many, and at most.
HOT, TRIE_TOKENS, LEAST_SETS, MOST_SETS = 48, 1 << 15, 16, 512
#: Rows handed over at a time, about 20 bytes each: Arrow keeps what it once held for a batch.
FLUSH = 1 << 19
#: Parts of a component, so that a large one is spread.
SUBS = 256
#: Parts of the classes under one leader, for the same reason.
SPREAD = 16
#: Pairs that may be broadcast, counted before; about 40 bytes each.
FEW = 50_000
#: Bits of a signature at most.
MOST_SIGNATURE = 1 << 16
_U = np.uint64
EMPTY = blake2b(b"", digest_size=16).digest()
NO_ID = -(1 << 62)


def name_of(s: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return blake2b(s.tobytes(), digest_size=16).digest()


def half_of(name: bytes) -> int:
    """The half of a name that candidates carry."""
    return int.from_bytes(name[:8], "little", signed=True)


def cells_for(size: int) -> int:
    """Counters for texts of size bytes, a power of two; a shingle for every six bytes."""
    want = size // 6 // PER_CELL
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << want.bit_length()))


def cells(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes >> _U(65 - width.bit_length())).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on: the upper bytes of small numbers are zeros, which pack to nothing when they lie together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def sliced(whole: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    for k, part in enumerate(whole.reshape(-1, size)):
        if part.any():
            yield k, zlib.compress(planes(part), 1)


def merged(df: DataFrame, dtype: type, cells_: int, size: int, finish: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Sums (or, for bits, unions) of the slices of all tasks, each made bytes by finish, as one array of bytes of a fixed size on the driver."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, blob in zip(pdf["slice"], pdf["blob"]):
                part = from_planes(zlib.decompress(blob), dtype)
                if dtype is np.uint8:
                    held[k] = held[k] | part if k in held else part
                elif k in held:
                    held[k] += part
                else:
                    held[k] = part.astype(np.int64)
        if held:
            yield pd.DataFrame({"slice": list(held), "blob": [zlib.compress((finish(v) if finish else v).tobytes(), 1) for v in held.values()]})

    out = np.zeros(cells_, np.uint8)
    parts = df.repartition(partitions(df.sparkSession), "slice").mapInPandas(tidily(add), "slice int, blob binary")
    for r in parts.collect():  # at most cells_ / size rows of a fixed size
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(zlib.decompress(r["blob"]), np.uint8)
    return out


def survey(docs: DataFrame, width: int, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n, name, class, keep) of every row, and the slices of every task's sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, waiting, held = np.zeros(width, np.int32), [], 0
        for pdf in batches:
            n, names = [], []
            for _, texts in blocks(pdf["text"]):
                for s in shingle_sets(texts):
                    n.append(len(s))
                    names.append(name_of(s) if len(s) else None)
                    waiting.append(cells(s, width))
                    held += len(s)
                if held > FLUSH:
                    np.add.at(sketch, np.concatenate(waiting), 1)
                    waiting, held = [], 0
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": n, "name": names, "class": pd.array([None if x is None else half_of(x) for x in names], "Int64"), "slice": pd.array([None] * len(n), "Int32"), "blob": None} | {c: pdf[c] for c in keep})
        if held:
            np.add.at(sketch, np.concatenate(waiting), 1)
        got = list(sliced(sketch, SLICE))
        if got:
            yield pd.DataFrame({"doc_id": None, "n": pd.array([None] * len(got), "Int64"), "name": None, "class": pd.array([None] * len(got), "Int64"), "slice": [k for k, _ in got], "blob": [b for _, b in got]} | dict.fromkeys(keep))

    return with_ids(docs.select("doc_id", "text", *keep), tidily(run), "doc_id long, n long, name binary, class long, slice int, blob binary" + "".join(f", {c} string" for c in keep))


def levels_of(counts: np.ndarray, mean: float) -> np.ndarray:
    """A level for each cell: 0 where the count is what collisions alone would make, then one more for each doubling of the excess."""
    excess, least = counts - mean, max(12.0, 5 * mean**0.5)
    out, high = np.zeros(len(counts), np.uint8), np.flatnonzero(excess >= least)
    out[high] = np.minimum(1 + np.log2(excess[high] / least), (1 << LEVEL_BITS) - 1)
    return out


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set's tokens in the global order."""
    return np.sort((levels[cells(s, len(levels))].astype(_U) << _U(64 - LEVEL_BITS)) | (s >> _U(LEVEL_BITS)))


def prefix(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def postings(docs: DataFrame, levels, buckets: int) -> DataFrame:
    """The tokens of every class's prefix, packed by bucket: tokens, classes, sizes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level, seen = levels.value, set()
        tok, cls, size, held = [], [], [], 0

        def packed() -> pd.DataFrame:
            t, c, n = np.concatenate(tok), np.concatenate(cls), np.concatenate(size)
            b = (mix(t) % _U(buckets)).astype(np.int64)
            by = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[by], np.arange(buckets + 1))
            rows = [(k, t[by[i:j]].tobytes() + c[by[i:j]].tobytes() + planes(n[by[i:j]])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
            return pd.DataFrame(rows, columns=["bucket", "blob"])

        for pdf in batches:
            for _, texts in blocks(pdf["text"]):
                for s in shingle_sets(texts):
                    if not len(s) or (whole := name_of(s)) in seen:
                        continue
                    seen.add(whole)
                    m, name = prefix(len(s)), half_of(whole)
                    tok.append(ordered(s, level)[:m])
                    cls.append(np.full(m, name, np.int64))
                    size.append(np.full(m, len(s), np.int32))
                    held += m
                if held > FLUSH:
                    yield packed()
                    tok, cls, size, held = [], [], [], 0
        if held:
            yield packed()

    return docs.select("text").mapInPandas(tidily(run), "bucket int, blob binary")


def unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    out = [[], [], []]
    for b in blobs:
        n, at = len(b) // 20, 0
        for k, kind in enumerate((_U, np.int64)):
            out[k].append(np.frombuffer(b, kind, n, at))
            at += 8 * n
        out[2].append(from_planes(b[at:], np.int32))
    return [np.concatenate(x) for x in out]


#: In place of a count of shared tokens: the pair is a leader's and one under it.
LISTED = 1 << 40


def pairs_in(tok: np.ndarray, cls: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows (leader, other, shared tokens, sizes) of the candidates among these postings."""
    by = np.argsort(tok, kind="stable")
    t = tok[by]
    same = np.zeros(len(t) + 1, bool)
    same[1:-1] = t[1:] == t[:-1]
    by = by[same[1:] | same[:-1]]  # tokens of one posting can't make a pair
    if not len(by):
        return np.empty((0, 4), np.int64)
    by = by[np.lexsort((cls[by], size[by], tok[by]))]
    t, c, n = tok[by], cls[by], size[by].astype(np.int64)
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])  # copies of a class from several tasks
    t, c, n = t[first], c[first], n[first]
    start = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    length = np.diff(np.r_[start, len(t)])
    run = np.repeat(np.arange(len(start)), length)
    found = []
    small = length[run] <= HOT
    for d in range(1, min(HOT, int(length.max(initial=1)))):
        i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:]))
        i = i[4 * n[i] >= 3 * n[i + d]]
        if len(i):
            found.append(np.stack([c[i], c[i + d], np.ones(len(i), np.int64), n[i] << 32 | n[i + d]], 1))
    for r in np.flatnonzero(length > HOT):
        a, b = start[r], start[r] + length[r]
        sizes, names, at = n[a:b], c[a:b], 0
        while at < len(sizes):  # sorted by size; a block holds both ends of every pair whose smaller size is within 4/3 of the leader's
            s = int(sizes[at])
            end = int(np.searchsorted(sizes * 9, 16 * s, side="right"))
            if end - at > 1:
                others = slice(at + 1, end)
                found.append(np.stack([np.full(end - at - 1, names[at]), names[others], np.full(end - at - 1, LISTED), s << 32 | sizes[others]], 1))
            at = int(np.searchsorted(sizes * 3, 4 * s, side="right"))
    return distinct(np.concatenate(found)) if found else np.empty((0, 4), np.int64)


def distinct(rows: np.ndarray) -> np.ndarray:
    """The distinct pairs with their shared tokens added up."""
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    first = np.flatnonzero(keep)
    out = rows[first]
    out[:, 2] = np.add.reduceat(rows[:, 2], first)
    return out


def possible(rows: np.ndarray) -> np.ndarray:
    """Which pairs can reach the threshold: what both prefixes share and what remains behind the prefix that ends first."""
    m, n = rows[:, 3] >> 32, rows[:, 3] & 0xFFFFFFFF
    rest = np.maximum((3 * m + 3) // 4, (3 * n + 3) // 4) - 1
    return (rows[:, 2] >= LISTED) | (rows[:, 2] + rest >= (3 * (m + n) + 6) // 7)


def packed_rows(rows: np.ndarray) -> bytes:
    """Rows of pairs column by column and packed: a pair may come from every task that met one of its tokens."""
    return zlib.compress(np.ascontiguousarray(rows.T).tobytes(), 1)


def unpacked_rows(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.int64).reshape(4, -1).T


def candidates(docs: DataFrame, levels) -> DataFrame:
    """(a, b, hot, n): the classes that may link, each pair once; n: the size of b."""
    n = partitions(docs.sparkSession)
    buckets = 4 * n

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blobs: dict[int, list[bytes]] = {}
        for pdf in batches:
            for k, b in zip(pdf["bucket"], pdf["blob"]):
                blobs.setdefault(k, []).append(b)
        found = [rows for k in list(blobs) if len(rows := pairs_in(*unpacked(blobs.pop(k))))]
        if found:
            rows = distinct(np.concatenate(found))
            to = (mix(rows[:, 0].astype(_U) ^ mix(rows[:, 1].astype(_U))) % _U(n)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[by], np.arange(n + 1))
            yield pd.DataFrame([(k, packed_rows(rows[by[i:j]])) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i], columns=["bucket", "blob"])

    def once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for k, b in zip(pdf["bucket"], pdf["blob"]):
                held.setdefault(k, []).append(unpacked_rows(b))
        for k in list(held):
            rows = distinct(np.concatenate(held.pop(k)))
            rows = rows[possible(rows)]
            for i in range(0, len(rows), FLUSH):
                part = rows[i : i + FLUSH]
                yield pd.DataFrame({"a": part[:, 0], "b": part[:, 1], "hot": (part[:, 2] >= LISTED).astype(np.int64), "n": part[:, 3] & 0xFFFFFFFF})

    met = postings(docs, levels, buckets).repartition(n, "bucket").mapInPandas(tidily(meet), "bucket int, blob binary")
    return met.repartition(n, "bucket").mapInPandas(tidily(once), "a long, b long, hot long, n long")


def marks(names: list[bytes], ids: np.ndarray) -> np.ndarray:
    """The bit of a class and the document that stands for it."""
    lo, hi = np.frombuffer(b"".join(names), "<u8").reshape(-1, 2).T
    return (mix(lo ^ mix(hi ^ mix(ids.astype(np.int64).astype(_U)))) % _U(BITS)).astype(np.int64)


def bits_of(wanted: DataFrame) -> np.ndarray:
    """A bit for every row (name, doc_id); of fixed size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, any_ = np.zeros(BITS // 8, np.uint8), False
        for pdf in batches:
            at = marks(list(pdf["name"]), pdf["doc_id"].to_numpy(np.int64))
            np.bitwise_or.at(bits, at >> 3, (128 >> (at & 7)).astype(np.uint8))
            any_ |= len(pdf) > 0
        got = list(sliced(bits, 1 << 14)) if any_ else []
        if got:
            yield pd.DataFrame(got, columns=["slice", "blob"])

    return merged(wanted.select("name", "doc_id").mapInPandas(tidily(run), "slice int, blob binary"), np.uint8, BITS // 8, 1 << 14)


def signature(s: np.ndarray) -> bytes:
    """Bits of a set, a power of two of them and about two for each token: a bit that two signatures don't share stands for a token that the sets don't share."""
    size = min(MOST_SIGNATURE, max(256, 1 << (2 * len(s)).bit_length()))
    out = np.zeros(size // 8, np.uint8)
    at = (mix(s) & _U(size - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


def folded(signature_: bytes, size: int) -> np.ndarray:
    """A signature at a smaller size, as numbers of 64 bits."""
    return np.bitwise_or.reduce(np.frombuffer(signature_, np.uint64).reshape(-1, size // 64), 0)


def texts_of(docs: DataFrame, bits) -> DataFrame:
    """(class, name, signature, text) of the classes in bits: packed texts, which are smaller than their sets."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = bits.value
        for pdf in batches:
            for first, texts in blocks(pdf["text"]):
                sets = shingle_sets(texts)
                names = [name_of(s) for s in sets]
                at = marks(names, pdf["doc_id"].iloc[first : first + len(texts)].to_numpy(np.int64))
                use = np.flatnonzero(wanted[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).tolist()
                use = [i for i in use if names[i] != EMPTY]
                if use:
                    yield pd.DataFrame({"class": [half_of(names[i]) for i in use], "name": [names[i] for i in use], "signature": [signature(sets[i]) for i in use], "text": [zlib.compress(texts[i], 3) for i in use]})

    # of equal rows each gives a text
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text").mapInPandas(tidily(run), "class long, name binary, signature binary, text binary").dropDuplicates(["name"])


def unpacked_sets(packed: list[bytes], levels: np.ndarray) -> list[np.ndarray]:
    """The ordered sets of packed texts."""
    out: list[np.ndarray] = []
    for b in packed:
        out.append(ordered(shingle_sets([zlib.decompress(b)])[0], levels))
    return out


class Trie:
    """Sets in lexicographic order as a radix tree: a node holds the tokens that all sets below it share from its parent on.

    groups: of each set, for walks that leave out the sets of one group. Walks may also be
    held to some of the sets: subtrees that hold none of them are left at once.
    """

    def __init__(self, sets: list[np.ndarray], groups: Sequence[bytes] | None = None):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        rows = [sets[i] for i in order]
        shared = np.zeros(len(rows), np.int64)
        for k, (x, y) in enumerate(zip(rows, rows[1:]), 1):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared[k] = differ[0] if len(differ) else m
        sizes = np.array([len(x) for x in rows], np.int64)
        self.order = np.array(order, np.int64)
        #: (tokens, depth above, least and most size below, sets that end here, children, group of all sets below or None, first and last place of its sets in order)
        self.nodes: list[tuple[np.ndarray, int, int, int, list[int], list[int], bytes | None, int, int]] = []
        todo, self.roots = [], []
        if rows:
            cuts = np.r_[np.flatnonzero(shared == 0), len(rows)]
            todo = [(int(a), int(b), 0, self.roots) for a, b in zip(cuts[:-1], cuts[1:])]
        while todo:
            a, b, above, siblings = todo.pop()
            depth = int(shared[a + 1 : b].min()) if b - a > 1 else int(sizes[a])
            ends, at = [], a
            while at < b and sizes[at] == depth:
                ends.append(order[at])
                at += 1
            below: list[int] = []
            of = None if groups is None or len({groups[i] for i in order[a:b]}) > 1 else groups[order[a]]
            siblings.append(len(self.nodes))
            self.nodes.append((rows[a][above:depth], above, int(sizes[a:b].min()), int(sizes[a:b].max()), ends, below, of, a, b))
            if at < b:
                cuts = np.r_[at, at + 1 + np.flatnonzero(shared[at + 1 : b] == depth), b]
                todo += [(int(x), int(y), depth, below) for x, y in zip(cuts[:-1], cuts[1:])]

    def linked(self, query: np.ndarray, own: Callable[[bytes], bool] | None = None, chunk: int = 128, some: np.ndarray | None = None) -> Iterator[int]:
        """Numbers of the sets that reach the threshold with the query; subtrees of a group that own says is the query's aren't walked, nor those without any of some (a truth value for each set)."""
        n = len(query)
        upto = None if some is None else np.r_[0, np.cumsum(some[self.order])].tolist()

        def hopeless(overlap: int, depth: int, used: int, least: int, most: int) -> bool:
            """Whether no size from least to most can reach the threshold, with overlap counted down to depth and used tokens of the query passed."""
            size = min(max(depth + n - used, least), most)
            return 7 * (overlap + min(n - used, size - depth)) < 3 * (size + n)

        walk = [(k, 0, 0) for k in self.roots]
        while walk:
            k, overlap, used = walk.pop()
            tokens, depth, least, most, ends, below, of, a, b = self.nodes[k]
            if upto is not None and upto[a] == upto[b] or own is not None and of is not None and own(of):
                continue
            done = 0
            while True:
                if hopeless(overlap, depth + done, used, least, most):
                    break
                if done == len(tokens):
                    if 7 * overlap >= 3 * (depth + done + n):
                        yield from ends
                    walk += [(c, overlap, used) for c in below]
                    break
                part = tokens[done : done + chunk]
                at = np.searchsorted(query, part)
                overlap += int(np.count_nonzero(query[np.minimum(at, n - 1)] == part))
                used = int(np.searchsorted(query, part[-1], side="right"))
                done += len(part)


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[list[tuple]]:
    """The rows of each key, of a partition sorted by key."""
    key, rows = None, []
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            if rows and row[: len(keys)] != key:
                yield rows
                rows = []
            key = row[: len(keys)]
            rows.append(row)
    if rows:
        yield rows


class Signatures:
    """Bounds on what sets share, from their signatures at the size of the smallest."""

    def __init__(self, packed: list[bytes], sizes: np.ndarray):
        self.sizes, self.width = sizes, min(8 * len(x) for x in packed)
        self.marks = np.stack([folded(x, self.width) for x in packed])

    def may_link(self, k: int, n: int) -> np.ndarray:
        """Which of the first n sets can reach the threshold with set k."""
        differ = np.bitwise_count(self.marks[:n] ^ self.marks[k]).sum(1, dtype=np.int64)
        both = self.sizes[:n] + self.sizes[k]
        return 7 * np.minimum((both - differ) // 2, np.minimum(self.sizes[:n], self.sizes[k])) >= 3 * both


def tries(tokens: Column, sets: Column) -> Column:
    """Into how many tries so many sets are dealt: long ones aren't dealt one by one, as each trie gets its leader's text."""
    return F.greatest(F.least(F.ceil(tokens / TRIE_TOKENS), F.ceil(sets / LEAST_SETS)), F.ceil(sets / MOST_SETS)).cast("int")


def under_leader(pairs: DataFrame, leaders: DataFrame, how: str = "inner", by: str = "b") -> DataFrame:
    """pairs with the columns of leaders (a, ...), which has a row for each of few a: each meets the classes under it in SPREAD parts."""
    parts = leaders.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return pairs.withColumn("spread", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int")).join(parts, ["a", "spread"], how).drop("spread")


def verified(pairs: DataFrame, texts: DataFrame, levels) -> DataFrame:
    """(a, b): names of the pairs that reach the threshold; pairs: written, so that they can be counted: few are sent to the texts instead of the texts to them."""
    few = F.broadcast if pairs.limit(FEW + 1).count() <= FEW else lambda df: df
    salts = pairs.groupBy("a").agg(tries(F.sum("n"), F.count(F.lit(1))).alias("salts"))
    members = under_leader(pairs, salts.where("salts > 1"), "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int"))
    texts = texts.select("class", "name", "text")
    members = few(members).join(texts, F.col("b") == F.col("class")).select("a", "salt", F.lit(1).alias("member"), "name", "text")
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    leaders = few(leaders).join(texts, F.col("a") == F.col("class")).select("a", "salt", F.lit(0).alias("member"), "name", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for rows in grouped(batches, ["a", "salt"]):
            sets = unpacked_sets([r[4] for r in rows], levels.value)
            n = sum(not r[2] for r in rows)  # leaders come first; more than one only if their halves are equal
            trie = Trie(sets[n:])
            for leader, query in zip(rows[:n], sets[:n]):
                for k in trie.linked(query):
                    a.append(leader[3])
                    b.append(rows[n + k][3])
            if len(a) > 10_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": a, "b": b})

    together = members.unionByName(leaders).repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")
    return together.mapInPandas(tidily(run), "a binary, b binary")


def placed(texts: DataFrame, components: DataFrame) -> DataFrame:
    """(class, name, component) of every text."""
    return texts.select("class", "name").join(components, "name", "left").select("class", "name", F.coalesce("component", "name").alias("component"))


def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose classes are in different components."""
    a = leaders_of(pairs, known)
    b = known.select(F.col("class").alias("b"), F.col("component").alias("cb"))
    return under_leader(pairs, a).join(b, "b").where("ca != cb").select(pairs.columns).distinct()


def leaders_of(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(a, ca): the component of each leader."""
    return pairs.select("a").distinct().join(known.select(F.col("class").alias("a"), F.col("component").alias("ca")), "a")


def rest_of_hot(pairs: DataFrame, components: DataFrame, texts: DataFrame, levels) -> DataFrame:
    """(a, b): links across components among the classes under one hot leader."""
    known = placed(texts, components)
    own = known.select(F.col("class").alias("b"), F.col("name").alias("b_name"), F.col("component").alias("cb"))
    listed = pairs.where("hot = 1")
    under = under_leader(listed.join(own, "b"), leaders_of(listed, known)).select("a", F.col("b_name").alias("name"), "n", "cb", (F.col("ca") != F.col("cb")).alias("away"))
    under = written(under, "under-leaders")
    open_ = under.groupBy("a").agg(tries(F.sum("n"), F.count(F.lit(1))).alias("salts"), F.max("away").alias("any"))
    open_ = open_.where("any").select("a", "salts")
    under = under_leader(under, open_, by="name").withColumn("salt", F.pmod(F.xxhash64("name"), F.col("salts")).cast("int"))
    members = under.select("a", "salt", F.lit(1).alias("member"), "away", "name", "cb", "n")
    # a class that is away walks its own trie as a member, and those of the other salts
    guests = under.where("away and salts > 1").select("a", "salt", "name", "cb", "n", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("other"))
    guests = guests.where("other != salt").select("a", F.col("other").alias("salt"), F.lit(2).alias("member"), F.lit(True).alias("away"), "name", "cb", "n")
    every = members.unionByName(guests)

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped(batches, ["a", "salt"]):
            n = sum(r[2] == 1 for r in rows)
            sizes, owners = np.array([r[6] for r in rows], np.int64), np.array([r[5] for r in rows], object)
            signs = Signatures([r[7] for r in rows], sizes)
            asks, asked = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
            for k in np.flatnonzero([r[3] for r in rows]).tolist():
                hit = signs.may_link(k, n) & (owners[:n] != owners[k])
                if hit.any():
                    asks[k] = True
                    asked[:n] |= hit
            use = np.flatnonzero(asks | asked).tolist()
            if use:
                yield pd.DataFrame([(*rows[k][:3], bool(asks[k]), *rows[k][4:6]) for k in use], columns=["a", "salt", "member", "away", "name", "cb"])

    light = together(every.join(texts.select("name", "signature"), "name").select("a", "salt", "member", "away", "name", "cb", "n", "signature"))
    left = written(light.mapInPandas(tidily(promising), "a long, salt int, member int, away boolean, name binary, cb binary"), "promising")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped(batches, ["a", "salt"]):
            n = sum(r[2] == 1 for r in rows)
            sets = unpacked_sets([r[6] for r in rows], levels.value)
            signs = Signatures([signature(x) for x in sets], np.array([len(x) for x in sets], np.int64))
            trie = Trie(sets[:n], [r[5] for r in rows[:n]])
            joined: dict[bytes, bytes] = {}  # components, as far as they are joined here

            def top(x: bytes) -> bytes:
                while x in joined:
                    x = joined[x]
                return x

            a, b = [], []
            for k, q in enumerate(rows):
                if not q[3]:
                    continue
                for m in trie.linked(sets[k], lambda of: top(of) == top(q[5]), some=signs.may_link(k, n)):  # noqa: B023
                    a.append(q[4])
                    b.append(rows[m][4])
                    if top(rows[m][5]) != top(q[5]):
                        joined[top(rows[m][5])] = top(q[5])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    rows = left.join(texts.select("name", "text"), "name").select("a", "salt", "member", "away", "name", "cb", "text")
    return together(rows).mapInPandas(tidily(run), "a binary, b binary")


def components_of(links: DataFrame) -> DataFrame:
    """(name, component) of every class that has a link; component: the smallest name reachable.

    Alternating stars: each round hangs every node's larger, then its smaller
    neighbours under the smallest of them, until every node hangs under one that hangs under none.
    """
    def stars(edges: DataFrame, large: bool) -> DataFrame:
        by = Window.partitionBy("u")  # one shuffle, where a minimum that is joined back takes two
        if large:
            near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            near = near.withColumn("m", F.least(F.min("v").over(by), F.col("u")))
            return near.where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = edges.withColumn("m", F.min("v").over(by))
        ends = F.explode(F.array("u", "v")).alias("u")
        return near.select(ends, F.col("m").alias("v")).where("u != v").distinct()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    while True:
        edges = written(stars(stars(edges, True), False), "stars")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("name"), F.lit(1).alias("up")), F.struct(F.col("v").alias("name"), F.lit(0).alias("up")))).alias("x"))
        ends = ends.groupBy("x.name").agg(F.sum("x.up").alias("ups"), F.count(F.lit(1)).alias("n"))
        if ends.where("ups > 1 or ups > 0 and n > ups").isEmpty():
            break
    tops = edges.select(F.col("v").alias("name"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("name"), F.col("v").alias("component")).unionByName(tops)


def extended(components: DataFrame, links: DataFrame) -> DataFrame:
    """components with more links: only these are followed, between the components found before."""
    if links.isEmpty():
        return components
    own = [components.select(F.col("name").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
    edges = links.join(own[0], "a", "left").join(own[1], "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    edges = written(edges, "new-links")
    tops = components_of(edges.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("name").alias("component"), F.col("component").alias("top"))
    ends = edges.select(F.col("a").alias("name"), F.col("ca").alias("component")).unionByName(edges.select(F.col("b").alias("name"), F.col("cb").alias("component")))
    every = components.unionByName(ends).distinct()
    return written(every.join(tops, "component", "left").select("name", F.coalesce("top", "component").alias("component")), "components")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, keep) of every row of docs; keep: string columns of docs; n_links: how many links of its class were verified: all but some between classes of one component that a token of more than HOT classes lists."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    width = cells_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    seen = written(survey(docs, width, keep), "survey")
    mean = (seen.agg(F.sum("n")).first()[0] or 0) / width
    slices = seen.where("slice is not null").select("slice", "blob")
    levels = spark.sparkContext.broadcast(merged(slices, np.int32, width, SLICE, lambda counts: levels_of(counts, mean)))  # MOST_CELLS bytes at most
    pairs = written(candidates(docs, levels), "candidates")
    rows = seen.where("slice is null").select("doc_id", F.col("n").alias("n_shingles"), "name", "class", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part"), *keep)
    # parts of a class, so that a class of many copies is spread
    parts = rows.where("name is not null").groupBy("name", "class", "part").agg(F.min("doc_id").alias("least"))
    classes = parts.groupBy("name", "class").agg(F.min("least").alias("least"))
    ends = pairs.select(F.col("a").alias("class")).unionAll(pairs.select(F.col("b").alias("class"))).distinct()
    stand = classes.join(ends, "class").select("name", F.coalesce("least", F.lit(NO_ID)).alias("doc_id"))
    bits = spark.sparkContext.broadcast(bits_of(stand))
    texts = written(texts_of(docs, bits), "texts")
    listed = pairs.where("hot = 1").select("a", "b", "n")
    first = listed.groupBy("b").agg(F.min("a").alias("a"), F.first("n").alias("n")).select("a", "b", "n")
    tried = written(pairs.where("hot = 0").select("a", "b", "n").unionByName(first), "tried")
    links = written(verified(tried, texts, levels), "first-links")
    components = components_of(links)
    others = written(apart(listed, placed(texts, components)), "others")
    second = written(verified(others, texts, levels), "links")
    links, components = links.unionByName(second).distinct(), extended(components, second)
    more = written(rest_of_hot(pairs, components, texts, levels), "more-links")
    for held in (levels, bits):  # all that reads them is written
        held.destroy()
    del levels, bits
    give_back()
    links, components = links.unionByName(more).distinct(), extended(components, more)

    ends = links.select(F.col("a").alias("name")).unionAll(links.select(F.col("b").alias("name")))
    degree = ends.groupBy("name").agg(F.count(F.lit(1)).alias("n_links"))
    # smallest doc_id of a component: of its parts, of these, and back, so that no task gets a whole component
    inside = components.join(classes, "name").withColumn("sub", F.pmod(F.xxhash64("name"), F.lit(SUBS)).cast("int"))
    by_sub = inside.groupBy("component", "sub").agg(F.min("least").alias("least"))
    ids = by_sub.groupBy("component").agg(F.min("least").alias("component_id"))
    named = inside.join(by_sub.select("component", "sub").join(ids, "component"), ["component", "sub"]).select("name", "component_id").join(degree, "name", "left")
    by_part = parts.select("name", "part").join(classes.drop("class"), "name").join(named, "name", "left").select("name", "part", F.coalesce("component_id", "least").alias("component_id"), "n_links")
    out = rows.join(by_part, ["name", "part"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group of near copies.

    A null doc_id loses against any other; a group of nulls alone keeps every row, and so do rows that share a group's smallest doc_id.
    """
    small_batches(spark, STAGE_ROWS)
    found = join(digested(docs), keep=[DIGEST])
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", DIGEST))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, CAST(len(w) - 3 AS BIGINT)), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
