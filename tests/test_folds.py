"""Packing in parts against a plain loop: starts by pointer doubling, groups that go on over parts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewake.operators import folds, shaping


def plain_loop(costs, counts, budget, most, state=None):
    """Group numbers of one key's rows, and (cost, count, number) of the group that is open at the end; state: what is open before."""
    used, n, group = state or (0, 0, 0)
    out = []
    for c, m in zip(costs, counts):
        if n and (used + c > budget or n + m > most):
            group, used, n = group + 1, 0, 0
        used, n = used + c, n + m
        out.append(group)
    return out, (used, n, group)


ROWS = st.lists(st.tuples(st.integers(0, 12), st.integers(1, 3), st.booleans()), min_size=1, max_size=40)


@settings(max_examples=300, deadline=None)
@given(ROWS, st.integers(1, 25), st.sampled_from([2, 5, folds.NO_LIMIT]), st.none() | st.tuples(st.integers(0, 30), st.integers(1, 4), st.integers(0, 9)))
def test_groups_of_a_part(rows, budget, most, before):
    cost, count, new = (np.array(x) for x in zip(*rows))
    new[0] = True
    got = folds.groups_of(folds.Chain(cost, count, new, budget, most), new, before).tolist()
    begins, want = [*np.flatnonzero(new).tolist(), len(rows)], []
    for k, (a, b) in enumerate(zip(begins, begins[1:])):
        want += plain_loop(cost[a:b].tolist(), count[a:b].tolist(), budget, most, before if k == 0 else None)[0]
    assert got == want


@settings(max_examples=300, deadline=None)
@given(ROWS, st.integers(1, 25), st.sampled_from([2, 5, folds.NO_LIMIT]))
def test_what_is_open_at_the_end(rows, budget, most):
    cost, count, _ = (np.array(x) for x in zip(*rows))
    new = np.arange(len(rows)) == 0
    used, n, groups = folds.Chain(cost, count, new, budget, most).open_at_end(len(rows) - 1)
    for k in range(len(rows)):
        assert (used[k], n[k], groups[k] - 1) == plain_loop(cost[k:].tolist(), count[k:].tolist(), budget, most)[1]


@pytest.mark.parametrize("budget, most", [(50, 7), (400, None), (3, None), (10**6, None), (10**6, 1)])
def test_one_key_over_all_parts(spark, budget, most):
    """A key with nearly all rows, some with few, a null key, rows of one place."""
    rng = np.random.default_rng(budget)
    rows = [("hot", i, int(c)) for i, c in enumerate(rng.integers(0, 20, 1_500))] + [(k, i, int(rng.integers(0, 60))) for k in ("a", "z", None) for i in range(9)] + [("hot", 700, 5), ("z", None, 1)]
    df = spark.createDataFrame(rows, "k string, seq long, c long").repartition(5)
    got = {}
    for r in shaping.packed(df, "k", "seq", F.col("c"), budget, most).collect():
        got.setdefault((r["k"], r["seq"]), set()).add(r["group"])
    want = {}
    for key in ("hot", "a", "z", None):
        by = {}
        for k, s, c in rows:
            if k == key:
                by.setdefault(s, []).append(c)
        order = sorted(by, key=lambda s: (s is not None, s or 0))
        groups, _ = plain_loop([sum(by[s]) for s in order], [len(by[s]) for s in order], budget, most or folds.NO_LIMIT)
        want |= {(key, s): {g} for s, g in zip(order, groups)}
    assert got == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, seq long, c long")
    assert shaping.packed(df, "k", "seq", F.col("c"), 5).count() == 0
