"""Product codes against plain loops over Python's integers."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewake.llm import common
from tidewake.llm import vector_codes as vc


def plain_loop(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) of the kept rows, and the books; rows: (vec_id, vector, label) of one length."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    width = len(kept[0][1]) // parts
    part = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def best(x, book):
        return min((far(x, c), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[best(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [tuple(sum(x) // len(x) for x in zip(*got[k])) if k in got else c for k, c in enumerate(books[p])]
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        found = [best(part(v, p), books[p]) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    return [(i, code, e, by_label[label]) for i, code, e, label in out], books


def got_of(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    made, books = vc.compress(df, **how)
    return sorted((tuple(r) for r in vc.label_errors(made).select("vec_id", "code", "error", "label_error").collect()), key=repr), books


def vectors(seed, n, dim, scale=1.0, hot=0.0):
    rng = random.Random(seed)
    same = [0.25] * dim
    return [(rng.choice([None, rng.randrange(40), 2**53 + rng.randrange(5)]), same if rng.random() < hot else [rng.choice([0.0, -0.25, 0.5, rng.gauss(0, scale)]) for _ in range(dim)], rng.choice([None, 1, 2])) for _ in range(n)]


CASES = {
    "ties": (vectors(1, 300, 8), dict(parts=4, entries=16, rounds=2)),
    "hot": (vectors(2, 300, 8, hot=0.5), dict(parts=2, entries=7, rounds=3)),
    "few": (vectors(3, 5, 32), dict(parts=16, entries=64, rounds=2)),
    "wide": (vectors(4, 60, 64, 300.0), dict(parts=16, entries=64, rounds=2)),
    "one": ([(7, [0.1, -0.1], 1)], dict(parts=2, entries=256, rounds=0)),
    "large": (vectors(5, 40, 8, 3e5), dict(parts=8, entries=3, rounds=2)),
    "bad": (vectors(6, 40, 8) + [(1, None, 1), (None, None, None), (2, [math.nan] * 8, 1), (3, [math.inf] + [0.0] * 7, 2), (4, [-math.inf] + [0.0] * 7, 2), (5, [None] * 8, 1), (6, [0.0] * 7 + [None], None)], dict(parts=4, entries=8, rounds=2)),
}


@pytest.mark.parametrize("name, few", [(name, common.FEW) for name in CASES] + [("hot", 20), ("ties", 20)])
def test_equals_plain_loops(spark, monkeypatch, name, few):
    monkeypatch.setattr(common, "FEW", few)  # with 20 only the heaviest keys are broadcast
    rows, how = CASES[name]
    rows = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").collect()  # as floats
    rows = [tuple(r) for r in rows]
    want, books = plain_loop(rows, **how)
    got, found = got_of(spark, rows, **how)
    assert found == [[list(c) for c in b] for b in books]
    assert got == sorted(want, key=repr)


def test_the_query_is_the_plain_loop(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = plain_loop(rows, 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    assert sorted(tuple(r) for r in vc.query(spark, sf).collect()) == sorted((*r, digest) for r in want)


def test_vectors_that_cannot_be_coded(spark):
    rows = [(3, [0.5] * 4, 1), (1, [1.0] * 3, 1), (2, [], 2), (5, [1e30] * 4, 2), (4, [0.5] * 8, None), (6, [0.25] * 4, 1)]
    got, books = got_of(spark, rows, parts=4, entries=2, rounds=1)
    assert got == sorted([(3, "00000000", 0, 0), (6, "01010101", 0, 0), (1, None, None, 0), (2, None, None, None), (5, None, None, None), (4, None, None, None)], key=repr)
    assert books == [[[128], [64]]] * 4
    got, books = got_of(spark, rows[1:3], parts=4)
    assert books == [] and got == [(1, None, None, None), (2, None, None, None)]
    assert vc.codebooks_sha256([]) == hashlib.sha256(b"").hexdigest()


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 2)], "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("own") for c in ("row", "ints", "place", "part", "weight", "code", "error")})
    made, books = vc.compress(df, parts=2)
    assert [tuple(r) for r in vc.label_errors(made).select("vec_id", "code", "error", "label_error").collect()] == [(1, "0000", 0, 0)]
    assert vc.label_errors(vc.compress(df.limit(0)).rows).count() == 0


def test_decoded(spark):
    rows = [(i, [i / 4, -i / 4, 0.0, 1.0], 0) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made, books = vc.compress(df, parts=2, entries=6, rounds=2)  # an entry for each
    assert {r["vec_id"]: list(r["vector"]) for r in vc.decoded(made, books).collect()} == {i: v for i, v, _ in rows}
