"""Words of many texts at once, in numpy: where they lie and a 64-bit hash of each.

The texts of a block lie in one byte buffer. Words are read eight bytes at a time: a
hash mixes one such piece after the other into its state, so that words of different
bytes collide by chance only; words of more than LONG bytes are hashed by blake2b.
`equal` compares the bytes themselves, for callers that must not trust a hash. The
memory is proportional to a block: about BLOCK_BYTES of text, or one text if that is
longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

BLOCK_BYTES = 1 << 19
LONG = 64
_U = np.uint64
#: Odd factors of the length and of the state.
BY_LENGTH, BY_STATE = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: The first n bytes of a piece.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def byte_table(is_word: bytes | None = None, *, spaces: bool = False) -> np.ndarray:
    """Which of the 256 bytes belong to words: those given, or all but white space."""
    t = np.zeros(256, bool)
    if spaces:
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    else:
        t[list(is_word or b"")] = True
    return t


NOT_SPACE = byte_table(spaces=True)
#: ASCII letters and digits, and every byte of a character beyond ASCII.
ALNUM = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: ASCII letters, and every byte of a character beyond ASCII.
LETTERS = byte_table(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def blocks(texts) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts as bytes) of about BLOCK_BYTES; None is empty."""
    first, got, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if got and size + len(b) > BLOCK_BYTES:
            yield first, got
            first, got, size = i, [], 0
        got.append(b)
        size += len(b) + 1
    if got:
        yield first, got


def words(texts: list[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, first, buffer): of each word its hash and its bytes' place in the lower-cased buffer; first[i]:first[i + 1] are the words of text i."""
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = is_word[buf]
    turns = np.flatnonzero(np.diff(inside))
    start, end = turns[::2], turns[1::2]
    return spans(buf, start, end), start, end, np.searchsorted(start, offsets(texts)), buf


def offsets(texts: list[bytes]) -> np.ndarray:
    """Where each text begins in the buffer, and where it ends."""
    return np.cumsum([0, *[len(t) + 1 for t in texts]])


def pieces(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of a buffer on, as one number; beyond its end are zeros."""
    v = np.zeros(len(buf) + 8, _U)
    v[: len(buf)] = buf
    for n in (1, 2, 4):
        v[:-n] |= v[n:] << _U(8 * n)
    return v


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, eight: np.ndarray | None = None) -> np.ndarray:
    """The hash of each span of a buffer; eight: pieces(buf), where the caller has it."""
    eight = pieces(buf) if eight is None else eight
    size = end - start
    h = mix((eight[start] & FIRST[np.minimum(size, 8)]) ^ (size.astype(_U) * BY_LENGTH))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    at = 8
    while len(more):
        h[more] = mix(h[more] * BY_STATE ^ (eight[start[more] + at] & FIRST[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def equal(buf: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray, eight: np.ndarray) -> np.ndarray:
    """Whether each span holds the same bytes as the span numbered by like; eight: pieces(buf)."""
    size = end - start
    same = size == size[like]
    left = np.flatnonzero(same & (np.arange(len(start)) != like))
    at = 0
    while len(left) and at < LONG:
        keep = FIRST[np.minimum(size[left] - at, 8)]
        same[left] &= (eight[start[left] + at] & keep) == (eight[start[like[left]] + at] & keep)
        at += 8
        left = left[size[left] > at]
    for i in left.tolist():
        j = like[i]
        same[i] &= bool((buf[start[i] : end[i]] == buf[start[j] : end[j]]).all())
    return same


#: Odd factors that tell the places of a window apart.
PLACES = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)]


def shingle_sets(texts: list[bytes], is_word: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its five-word windows; fewer words are one window, none give none."""
    h, _, _, first, _ = words(texts, is_word)
    five = np.zeros(len(h), _U)
    m = len(h) - 4
    if m > 0:
        five[:m] = mix(sum(h[k : m + k] * PLACES[k] for k in range(5)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= 5:
            s = np.sort(five[a : b - 4])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            x = sum((h[a + k : a + k + 1] * PLACES[k] for k in range(b - a)), np.array([b - a], _U))
            out.append(mix(x))
        else:
            out.append(np.empty(0, _U))
    return out
