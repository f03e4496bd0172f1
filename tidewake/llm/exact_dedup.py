"""Exact deduplication by a tree-merge of sorted digest runs.

Every row gets a digest of its normalised text and belongs to a run, by a hash of its
doc_id. A run is sorted by digest and holds each digest once, with the smallest
identifier and the count of its rows. Then runs meet in rounds, FAN_IN partners at a
time (runs whose numbers differ in the round's base-FAN_IN digit alone): a merge sorts
the partners' rows together, keeps of equal digests the smallest identifier and adds the
counts. Each round is written once and read by the next; after the last one run is left.
Only its digests of more than one row go back to the first runs, so unique texts don't
travel down, and the rows of one large group are spread over all runs: no task ever
holds a whole group.

Digests are verified at every level by two independent hashes and the length: rows
are merged only if sha256, a second hash and the length in bytes all agree.

Defined results: a null text counts as empty; a very long text is hashed whole; equal
rows are members of one group, and if they share the smallest doc_id too, all of them are
kept; a null doc_id loses against any other, and a group of nulls alone keeps null and
every row; an empty table gives an empty table; other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DIGEST as TEXT_DIGEST
from .common import SPACES, digested, partitions, table, without, written

FAN_IN = 4
#: sha256 of the text, and a second hash and the length that verify it.
DIGEST = ["digest", "check_hash", "check_len"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep, digest columns) of every row."""
    text = docs.select(F.col(id_col).alias("doc_id"), *keep, normalised(F.col(text_col)).alias("t"))
    return text.select("doc_id", *keep, F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check_hash"), F.octet_length("t").alias("check_len"))


def rounds_for(spark: SparkSession) -> int:
    """Rounds so that there are at least as many runs as partitions, and 16."""
    n, rounds = FAN_IN**2, 2
    while n < partitions(spark):
        n, rounds = n * FAN_IN, rounds + 1
    return rounds


def merged(runs: DataFrame) -> DataFrame:
    """The runs of `run` as one sorted run for each number, every digest once."""
    level = runs.groupBy("run", *DIGEST).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return written(level.sortWithinPartitions("run", *DIGEST), "digest-runs")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, keep), one row per row of docs; keep: columns of docs."""
    rounds = rounds_for(docs.sparkSession)
    rows = digests(docs, id_col, text_col, keep).withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(FAN_IN**rounds)).cast("int"))
    rows = written(rows, "digests")  # the texts are read and hashed once
    first = level = merged(rows.select("run", *DIGEST, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    for _ in range(rounds):
        level = merged(level.withColumn("run", F.floor(F.col("run") / FAN_IN).cast("int")))
    several = level.where("group_size > 1").select(*DIGEST, "keep_id", "group_size")
    # a digest meets as many rows here as there are runs that hold it, and in the next join those of one run
    verdicts = first.select("run", *DIGEST).join(several, DIGEST)
    out = rows.join(verdicts.withColumn("found", F.lit(True)), ["run", *DIGEST], "left")
    keep_id = F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"), *keep)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that stay, as dedup defines it for null and repeated ids."""
    return without(docs, dedup(digested(docs), keep=[TEXT_DIGEST]).where(~F.col("kept")).select("doc_id", TEXT_DIGEST))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
