"""Hash trees: the differences of a full comparison, from the rows of unequal leaves alone."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import hashtree, snapshots

ENTRY = "path string, hash string"


def table(spark, d):
    return spark.createDataFrame(list(d.items()), ENTRY)


def changes(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("levels, n", [(1, 0), (2, 5), (3, 400)])
def test_as_a_full_comparison(spark, levels, n):
    rng = random.Random(n)
    a = {f"d{i % 5}/f{i}": rng.choice("xyz") for i in range(300)} | {"null": None}
    b = dict(a)
    for k in rng.sample(sorted(b), min(n, 200)):
        if rng.random() < 0.3:
            del b[k]
        else:
            b[k] = rng.choice(["x", "new", None])
    b |= {f"new{i}": "h" for i in range(n // 2)}
    p, c = table(spark, a).repartition(3), table(spark, b)
    assert changes(hashtree.diff_by_leaves(p, c, levels)) == changes(snapshots.diff(p, c))
    none = spark.createDataFrame([], ENTRY)
    assert changes(hashtree.diff_by_leaves(none, c, levels)) == changes(snapshots.diff(none, c)) and changes(hashtree.diff_by_leaves(c, none, levels)) == changes(snapshots.diff(c, none))
    assert hashtree.diff_by_leaves(none, none).count() == 0
    assert [tuple(r) for r in hashtree.tree(p, levels).where("level = 0").select("node", "n").collect()] == [(0, 301)]


def test_one_changed_file_reads_one_leaf(spark, tmp_path):
    rows = spark.range(5_000).select(F.format_string("d/f%d", "id").alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    old, new = (hashtree.Kept(spark, f"file://{tmp_path}/{name}") for name in ("old", "new"))
    assert old.tree().count() == 0
    old.write(rows)
    new.write(rows)
    assert new.equal(old) and new.changes(old)[1] == [] and new.changes(old)[0].count() == 0
    touched = new.change(spark.createDataFrame([("d/f77", "other")], ENTRY))
    found, leaves = new.changes(old)
    assert not new.equal(old) and changes(found) == [("d/f77", "modified")] and leaves == touched and len(leaves) == 1
    files = found.inputFiles()
    assert len(files) == 2 and all(f"_bucket={leaves[0]}/" in f for f in files)
    new.change(spark.createDataFrame([("d/f77", "other"), ("x", "y")], ENTRY), spark.createDataFrame([("d/f5",), ("unknown",)], "path string"))
    assert changes(new.changes(old)[0]) == [("d/f5", "removed"), ("d/f77", "modified"), ("x", "added")]
    own = new.rows.versions()
    assert changes(new.changes(new, own[-1], own[-2])[0]) == [("d/f5", "removed"), ("x", "added")]
    want = sorted(tuple(r) for r in hashtree.tree(new.rows.read()).collect())
    assert sorted(tuple(r) for r in new.tree().collect()) == want
    (tmp_path / "new" / "trees" / str(own[-1]) / "_SUCCESS").unlink()  # a write that was cut off before its tree
    assert sorted(tuple(r) for r in new.tree().collect()) == want
    assert sorted(p.name for p in (tmp_path / "new" / "trees").iterdir()) == [str(v) for v in own]
