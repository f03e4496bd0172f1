"""The similarity join against all pairs on small tables."""

import random
import re

import numpy as np
import pytest

from tidewake.llm import hashing, ngram_join


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 7 * len(a & b) >= 3 * (len(a) + len(b)):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i: (len(s), top(i)) for i, s in sets}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocab, k=70)
    out = [None, "", " \n", "one two", "One TWO", "one two three", "x " * 30_000, "É é É é É", "é é é é é"]
    for _ in range(n):
        base = rng.choices(vocab, k=rng.choice([4, 5, 6, 30, 80, 200]))
        if rng.random() < 0.3:
            base = base[:10] + passage + base[10:]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [48, 2])
def test_join_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = [(3 * i + 5, t) for i, t in enumerate(corpus(hot))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", ngram_join.F.lit("x"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df).collect()}
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "TRIE_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "LEAST_SETS", 3)
    rng = random.Random(1)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for k in range(120):
        w = list(base[: rng.choice([45, 60])])
        for _ in range(rng.choice([0, 1, 2])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(40)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_repeated_rows_empty_table_and_stage(spark):
    df = spark.createDataFrame([(4, "a b c d e f g"), (4, "a b c d e f g"), (9, "a b c d e f g"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.join(df).collect()) == [(1, 1), (4, 4), (4, 4), (9, 4)]
    assert ngram_join.join(df.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in ngram_join.stage(spark, df, "").collect()) == [1, 4, 4]


def test_trie_prunes_but_finds_all():
    rng = np.random.default_rng(3)
    query = np.sort(rng.choice(2_000, 100, False)).astype(np.uint64)
    sets = [np.sort(rng.choice(np.r_[query, rng.choice(2_000, 30)], rng.integers(40, 120), False)) for _ in range(200)]
    sets = [np.unique(s).astype(np.uint64) for s in sets] + [query, query[:80]]
    want = [k for k, s in enumerate(sets) if 7 * len(np.intersect1d(s, query)) >= 3 * (len(s) + len(query))]
    assert sorted(ngram_join.Trie(sets).linked(query, None, 16)) == want
    few = sets[0]
    assert sorted(ngram_join.Trie([few[:9], few[:5], few, few[:1]]).linked(few)) == [2]
    assert list(ngram_join.Trie([]).linked(query)) == []


def test_a_hopeless_subtree_is_left_at_once(monkeypatch):
    path = np.arange(1_000, 1_200, dtype=np.uint64)
    below = [np.r_[path, np.arange(k, k + 30)].astype(np.uint64) for k in range(2_000, 200_000, 100)]
    trie, looked = ngram_join.Trie(below), []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: looked.append(1) or search(a, v, **k))
    assert list(trie.linked(np.arange(0, 900, dtype=np.uint64))) == []
    assert len(trie.nodes) == 1 + len(below) and len(looked) <= 4  # one shared path was looked at, none of 1,980 branches
    looked.clear()
    assert list(trie.linked(below[7])) == list(range(len(below))) and len(looked) > len(below)
    assert list(trie.linked(below[7], lambda of: True)) == list(range(len(below)))  # no groups: nothing is left out
    own = ngram_join.Trie(below, [b"x"] * 5 + [b"y"] * (len(below) - 5))
    assert sorted(own.linked(below[7], lambda of: of == b"y")) == [0, 1, 2, 3, 4]


def test_texts_sent_for_a_passage_that_unlike_texts_share(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", 8)
    monkeypatch.setattr(ngram_join, "levels_of", lambda counts, mean: np.zeros(len(counts), np.uint8))  # the worst order: the passage leads to candidates
    sent = []
    real = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: sent.append((name, out := real(df, name))) or out)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(25)) + f" {passage} " + " ".join(f"v{i}x{j}" for j in range(25))) for i in range(2_000)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("doc_id != component_id").count() == 0
    count = {name: df.count() for name, df in sent}
    assert count["texts"] <= 2_000 and count["candidates"] <= 2_000 * 12 and count["links"] == count["more-links"] == 0


def test_words_that_collide_for_polynomials_dont_link(spark):
    word = "a"
    for _ in range(12):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word[:1024]), (4, other[:1024]), (5, word)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_hash_of_a_word_depends_on_its_bytes_alone():
    rng = np.random.default_rng(5)
    data = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*range(1, 80), 300]]
    alone = [hashing.words([w], hashing.NOT_SPACE)[0][0] for w in data]
    h, start, end, _, buf = hashing.words([b" ".join(data + data)], hashing.NOT_SPACE)
    assert h.tolist() == alone + alone and len(set(h.tolist())) == len(set(data))
    like = np.r_[np.arange(80), np.arange(80)]
    eight = hashing.pieces(buf)
    assert hashing.equal(buf, start, end, like, eight).all() and hashing.equal(buf, start, end, like[::-1], eight).sum() == sum(data[i] == data[79 - i] for i in range(80)) * 2


def test_word_hashes_tell_words_apart():
    texts = ["a b ab ba É é", "", "Ab AB"]
    h, start, end, first, _ = hashing.words([t.encode() for t in texts], hashing.NOT_SPACE)
    assert first.tolist() == [0, 6, 6, 8] and len(set(h[:6].tolist())) == 6 and h[6] == h[7] == h[2]
    many = [f"w{i}x{j}" for i in range(300) for j in range(300)]
    assert len(set(hashing.words([" ".join(many).encode()], hashing.NOT_SPACE)[0].tolist())) == len(many)


def test_later_links_join_the_components_found_before(spark, monkeypatch):
    rounds = []
    keep = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: rounds.append(name) or keep(df, name))
    name = lambda k: f"{k:02d}".encode()
    pairs = lambda rows: spark.createDataFrame([(name(a), name(b)) for a, b in rows], "a binary, b binary")
    first = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (20, 21)]
    found = ngram_join.components_of(pairs(first))
    assert {(bytes(r[0]), bytes(r[1])) for r in found.collect()} == {(name(a), name(b)) for a, b in [(k, 1) for k in range(1, 6)] + [(10, 10), (11, 10), (20, 20), (21, 20)]}
    rounds.clear()
    assert ngram_join.extended(found, pairs([])) is found and not rounds
    more = ngram_join.extended(found, pairs([(5, 11), (30, 21), (31, 32), (2, 3)]))
    assert {(bytes(r[0]), bytes(r[1])) for r in more.collect()} == {(name(a), name(b)) for a, b in [(k, 1) for k in (1, 2, 3, 4, 5, 10, 11)] + [(20, 20), (21, 20), (30, 20), (31, 31), (32, 31)]}
    assert rounds.count("stars") == 1


def test_a_walk_is_held_to_the_sets_that_may_link(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.choice(1 << 40, 300, False).astype(np.uint64)
    sets = [np.sort(np.r_[base[: 150 + k], rng.choice(1 << 40, 150 - k, False).astype(np.uint64)]) for k in range(0, 150, 3)]
    signs = ngram_join.Signatures([ngram_join.signature(s) for s in sets], np.array([len(s) for s in sets]))
    trie, looked = ngram_join.Trie(sets), []
    search = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **k: looked.append(1) or search(a, v, **k))
    for k, query in enumerate(sets):
        some = signs.may_link(k, len(sets))
        free = sorted(trie.linked(query))
        before = len(looked)
        assert sorted(trie.linked(query, some=some)) == free  # no link is lost
        if k == 0:
            assert free == [0] and len(looked) - before < 40  # unlike sets aren't read
    assert list(trie.linked(sets[0], some=np.zeros(len(sets), bool))) == []


def test_small_numbers_pack_to_their_lower_bytes():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.6, 1 << 16).astype(np.int32)
    counts[[5, 9]] = [2**31 - 1, 70_000]
    packed = dict(ngram_join.sliced(counts, 1 << 12))
    assert sum(map(len, packed.values())) < 0.65 * len(ngram_join.zlib.compress(counts.tobytes(), 1))
    back = np.concatenate([ngram_join.from_planes(ngram_join.zlib.decompress(packed[k]), np.int32) for k in sorted(packed)])
    assert (back == counts).all() and ngram_join.from_planes(b"", np.int32).tolist() == []
