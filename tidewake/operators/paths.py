"""Which root covers a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covers(root: Column, path: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path and all paths above it, as an array."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def covering(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root", strict: bool = False) -> DataFrame:
    """(path, root) of every root that covers a path: an equi-join over the path's ancestors, not a join of all with all."""
    up = paths.select(path, F.explode(ancestors(F.col(path))).alias(root))
    found = up.join(roots.select(root).distinct(), root)
    return found.where(F.col(root) != F.col(path)).select(path, root) if strict else found.select(path, root)


def nearest(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """(path, root): the longest root that covers it."""
    return covering(paths, roots, path, root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))


def descendants(roots: DataFrame, codebases: DataFrame, root: str = "root") -> DataFrame:
    """(root, path) of the codebases strictly below each root."""
    return covering(codebases.select(F.col(root).alias("path")), roots, "path", root, strict=True).select(root, "path")


def classified(path: Column, root: Column, excluded: Column, exists: Column, status: Column) -> Column:
    """What a path is to the index."""
    return F.when(root.isNull(), "untracked").when(~exists, "missing").when(excluded, "ignored").when(status == "indexed", "indexed").otherwise("pending")
