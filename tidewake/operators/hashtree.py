"""Snapshots as hash trees: what is equal is told by digests of whole subtrees and never read.

A path belongs to a leaf by its hash; sixteen nodes have one parent, up to the root. A
node's digest is the exclusive or of the hashes of its entries (path and hash), twice
with independent hashes, and their number, so digests of parents follow from those of
their children, a changed leaf changes its own way up alone, and no entry is sorted or
gathered. Two trees are compared from the root down below unequal nodes only; then the
entries of the unequal leaves are compared.

Kept snapshots are collections with a bucket for each leaf and the tree of each version
beside it, so a difference reads the rows of unequal leaves and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.collections import Collection
from ..sources.files import drop, exists
from .snapshots import diff

#: Nodes below one, as bits, and the levels below the root: 16 ** 2 leaves.
BITS, LEVELS = 4, 2
TREE = "level int, node int, first long, second long, n long"


def leaf_of(path: Column, levels: int = LEVELS) -> Column:
    """The leaf's number; the bucket that a collection of as many buckets puts the path in."""
    return F.pmod(F.xxhash64(path), F.lit(1 << BITS * levels)).cast("int")


def tree(snapshot: DataFrame, levels: int = LEVELS, key: str = "path", value: str = "hash") -> DataFrame:
    """(level, node, first, second, n) of every node that has entries: level 0 is the root.

    Tasks hand on a row for each leaf, whatever they read.
    """
    h = F.coalesce(F.col(value), F.lit("\0"))
    second = F.conv(F.substring(F.sha2(F.concat(F.col(key), F.lit("\0"), h), 256), 1, 15), 16, 10).cast("long")
    entries = snapshot.select(leaf_of(F.col(key), levels).alias("leaf"), F.xxhash64(key, h).alias("a"), second.alias("b"))
    leaves = entries.groupBy("leaf").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count(F.lit(1)).alias("n"))
    return raised(leaves, levels)


def raised(leaves: DataFrame, levels: int) -> DataFrame:
    """The tree over leaves (leaf, a, b, n)."""
    every = leaves.select("*", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    node = F.call_function("shiftright", F.col("leaf"), (F.lit(levels) - F.col("level")) * BITS)
    return every.groupBy("level", node.alias("node")).agg(F.bit_xor("a").alias("first"), F.bit_xor("b").alias("second"), F.sum("n").alias("n"))


def unequal(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> list[int]:
    """The leaves in which two trees differ, found from the root down; at most all leaves."""
    nodes = [0]
    for level in range(levels + 1):
        def of(tree: DataFrame) -> dict[int, tuple]:
            # the children of unequal nodes; of very many the range that holds them
            some = tree.where(F.col("level") == level).where(F.col("node").isin(nodes) if len(nodes) <= 1000 else F.col("node").between(min(nodes), max(nodes)))  # noqa: B023
            return {r["node"]: (r["first"], r["second"], r["n"]) for r in some.collect()}  # a row for each node of a level at most

        mine, other = of(a), of(b)
        differ = [k for k in nodes if mine.get(k) != other.get(k)]
        if level == levels or not differ:
            return differ
        nodes = [k << BITS | child for k in differ for child in range(1 << BITS)]
    return []


def diff_by_leaves(previous: DataFrame, current: DataFrame, levels: int = LEVELS) -> DataFrame:
    """snapshots.diff of two tables (path, hash), in which only rows of unequal leaves are joined."""
    leaves = unequal(tree(previous, levels), tree(current, levels), levels)
    inside = leaf_of(F.col("path"), levels).isin(leaves) if leaves else F.lit(False)
    return diff(previous.where(inside), current.where(inside))


# -- kept snapshots ---------------------------------------------------------------------------------


class Kept:
    """The snapshots (path, hash) in a folder: its versions, each with its tree."""

    def __init__(self, spark: SparkSession, path: str, levels: int = LEVELS):
        self.spark, self.levels, self.path = spark, levels, path.rstrip("/")
        self.rows = Collection(spark, f"{self.path}/rows")

    def _tree_path(self, version: int) -> str:
        return f"{self.path}/trees/{version}"

    def _keep(self, made: DataFrame) -> None:
        known = self.rows.versions()
        made.coalesce(1).sortWithinPartitions("level", "node").write.mode("overwrite").parquet(self._tree_path(known[-1]))
        for old in range(known[-1] - 1, 0, -1):
            if old not in known and not drop(self.spark, self._tree_path(old)):
                break

    def write(self, snapshot: DataFrame) -> None:
        """Keep a whole snapshot as the next version."""
        self.rows.create(snapshot.select("path", "hash"), "path", 1 << BITS * self.levels)
        self._keep(tree(self.rows.read(), self.levels))

    def change(self, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put entries in place of those with their paths, and drop those of the paths in gone; the leaves that were written. Only these are read for the new tree."""
        before = self.tree()
        touched = self.rows.upsert(new.select("path", "hash"), gone)
        if touched:
            names = {"first": "a", "second": "b", "node": "leaf"}
            at = F.col("level") == self.levels
            old = before.where(at & ~F.col("node").isin(touched)).withColumnsRenamed(names).select("leaf", "a", "b", "n")
            own = tree(self.rows.in_buckets(touched), self.levels).where(at).withColumnsRenamed(names).select("leaf", "a", "b", "n")
            self._keep(raised(old.unionByName(own), self.levels))
        return touched

    def tree(self, version: int | None = None) -> DataFrame:
        """The tree of a version, by default the last; made again if a write was cut off before it."""
        version = version or (self.rows.versions() or [0])[-1]
        if not version:
            return self.spark.createDataFrame([], TREE)
        if not exists(self.spark, f"{self._tree_path(version)}/_SUCCESS"):
            tree(self.rows.read(version), self.levels).coalesce(1).write.mode("overwrite").parquet(self._tree_path(version))
        return self.spark.read.schema(TREE).parquet(self._tree_path(version))

    def equal(self, other: Kept) -> bool:
        """Whether two snapshots are equal, by their roots."""
        root = lambda k: [tuple(r) for r in k.tree().where("level = 0").collect()]
        return root(self) == root(other)

    def changes(self, since: Kept, version: int | None = None, since_version: int | None = None) -> tuple[DataFrame, list[int]]:
        """(path, change) from another snapshot to this one, and the leaves whose rows it reads."""
        leaves = unequal(since.tree(since_version), self.tree(version), self.levels)
        return diff(since.rows.in_buckets(leaves, since_version), self.rows.in_buckets(leaves, version)), leaves
