"""Fill-in-middle against a plain loop over code points."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidewake.llm import fill_in_middle as fim

TEXTS = [
    None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "a\n\nb\n", "\r\nx\r", "é😀\n😀é\nß", "$0\n\\1\n$", "\x1e\n\x1e\x1e\n", "\x1b\n\x1bd\x1be\n\x1b\x1e\x1bd", "\x1ed\x1be\x1e\n" * 7,
    "<P>\nx", "x<S>", "<M>", "<P\n>S>\n<<P", "<S\n<\n>", "\x00\n\x1f\x85 \n", " \t\n ", "x" * 200_000, "y\n" * 40_000, "line one\nline two\n" * 3, "<\n" * 9,
]


def plain_loop(doc_id, text, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, None, text
    form = "spm" if h4 % 100 < spm_rate else "psm"
    return doc_id, n, form, p, m, s, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    ids = [None, 0, 1, -5, 2**53 + 1, 2**63 - 1, -(2**63), *range(40, 60)]
    return [(i, t) for t in TEXTS for i in (ids if len(t or "") < 50_000 else ids[:6])] + [(1, "a\nb")] * 2


@pytest.mark.parametrize("how", [{}, {"rate": 40, "spm_rate": 20, "seed": 3}])
def test_equals_a_plain_loop(spark, rows, how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in fim.transform(df, **how).collect()]
    assert sorted(got, key=repr) == sorted((plain_loop(*r, **how) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_are_taken_apart_again(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("own", F.coalesce("text", F.lit("")))
    again = fim.transform(df, keep=["own"]).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    assert again.where("again != own").count() == 0 and again.count() == len(rows)


def test_clashing_names_and_no_rows(spark):
    names = ["n", "form", "hashed", "marked", "low", "high", "own", "prefix", "output"]
    df = spark.createDataFrame([(1, "a\nb\nc\n")], "doc_id long, text string").withColumns({c: F.lit(f"my {c}") for c in names})
    (row,) = fim.transform(df, keep=["marked", "own"]).collect()
    assert tuple(row)[:7] == plain_loop(1, "a\nb\nc\n") and row["own"] == "my own" and row["marked"] == "my marked"
    assert tuple(fim.transform(df).first()) == plain_loop(1, "a\nb\nc\n")
    assert fim.transform(df.limit(0)).count() == 0


def test_one_pass_without_shuffle_or_python(spark):
    plan = fim.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
