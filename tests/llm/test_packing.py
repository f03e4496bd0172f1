"""Packing: ids as the tokenizer gives them, nothing lost, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " ", "Hello, World's best: it's 1234 ²½ don't'll", "ÉCOLE été ß ñ ÿ Ÿ", "Σίσυφος ΟΔΟΣ", "İstanbul é", "<|endoftext|> a <|x", "a\x1cb\x1fc", "日本語 😀 text", "\xa0x\x85y z", "a" * 3000, "%%%$$$ &&& x's'S", "word " * 9000, "\x00\x01"]


def test_encoder_is_the_tokenizer():
    encoder, t = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    for text, got in zip(HARD, encoder.encode(HARD)):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text


def turns(n):
    """Thue-Morse: 2 ** n letters."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_for_polynomials_keep_their_own_ids():
    encoder, t = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    one = turns(12)
    two = one.translate(str.maketrans("ab", "ba"))
    for text in (one, two, f"{two} {one}", one[:1024], two[:1024]):
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(packing.hashing, "mix", lambda x: x & np.uint64(3))
    encoder, t = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    text = " ".join(f"word{i} {'x' * i}" for i in range(70)) + " word3 word3 xxxx"
    for _ in range(2):
        assert np.frombuffer(next(encoder.encode([text])), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aAéÉ's1² .\n\t-ßÿ", max_size=60))
def test_encoder_on_any_text(text):
    global _pair
    if "_pair" not in globals():
        _pair = (packing.Encoder(PATH), Tokenizer.from_file(PATH))
    assert np.frombuffer(next(_pair[0].encode([text])), "<u4").tolist() == _pair[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    left, bins = dict(histogram), 0
    for times, found in packing.plan(histogram, 64):
        assert times >= 1 and sum(k * n for k, n in found.items()) <= 64
        bins += times
        for k, n in found.items():
            left[k] -= n * times
    assert not any(left.values())
    assert bins >= -(-sum(k * n for k, n in histogram.items()) // 64)


def test_fullest_is_the_best_sum():
    counts = {9: 2, 7: 1, 4: 3}
    sums = {9 * a + 7 * b + 4 * c for a in range(3) for b in range(2) for c in range(4)}
    for room in range(1, 40):
        got = packing.fullest(counts, [9, 7, 4], room)
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in got.items())


def test_pack_round_trip(spark):
    rng = np.random.default_rng(0)
    texts = HARD + ["w " * int(n) for n in rng.integers(0, 5_000, 150)]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, rank int")
    rows = packing.pack(df).collect()
    t = Tokenizer.from_file(PATH)
    parts, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, r in enumerate(sorted(parts[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["length"]) == (k, 4096 * k, min(4096, len(ids) - 4096 * k))
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sum(r["length"] for r in parts[i]) == len(ids)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 4096) + 2
    assert packing.pack(df.limit(0)).count() == 0
    assert packing.pack(df.limit(9).union(df.limit(9))).count() == 18
