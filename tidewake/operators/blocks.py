"""Keyword search from an index of blocks: most postings of a query's terms are never read.

Documents are dealt to slots of SLOT documents of about the same length. A block holds the
postings of one term in one slot, and the greatest contribution that any of them can make
to a score (but for the term's weight). The sum of these over a query's terms bounds the
scores of a slot's documents. The slots with the greatest bounds are scored first; their
best scores are a floor, and of all other slots only those whose bound reaches it are
scored at all. The result is that of the plain search. Bounds lie in columns of their own,
so slots that are left out cost a number for each term, not their postings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import staged
from .lexical import B, K1, terms
from .retrieval import order

#: Documents of a slot: fewer bound more sharply, more make fewer blocks.
SLOT = 8
#: Slots that are scored first, at least, and for each row of the result.
FIRST, FIRST_EACH = 20, 2
#: Ids that may be broadcast, counted before.
MOST_BROADCAST = 500_000
#: What sums in another order may differ by, relative to the score.
ROUNDING = 1e-9


def write(docs: DataFrame, path: str, id_col: str = "id", text: str = "content", k1: float = K1, b: float = B, slot: int = SLOT) -> None:
    """Keep blocks (term, slot, most, ids, tfs, lens) sorted by term, (term, df), and the corpus' numbers; ids are those of one document each."""
    lengths = docs.select(F.col(id_col).alias("id"), F.size(terms(F.col(text))).alias("len"))
    lengths = staged(lengths.repartitionByRange("len", "id").withColumn("part", F.spark_partition_id()), "lengths")
    numbers = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("len", "id")) - 1  # a range of lengths and ids each
    slots = lengths.withColumn("slot", F.shiftleft(F.col("part").cast("long"), 40) + F.floor(place / slot)).select("id", "slot")
    share = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    one = F.struct("id", F.col("tf").cast("int").alias("tf"), F.col("len").cast("int").alias("len"))
    # texts are shuffled to their slots; what is made of their words there isn't
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(slots, "id").repartition("slot")
    rows = texts.select("slot", "id", terms(F.col("text")).alias("w")).select("slot", "id", F.size("w").alias("len"), F.explode("w").alias("term"))
    rows = rows.groupBy("slot", "term", "id", "len").agg(F.count(F.lit(1)).alias("tf"))
    blocks = rows.crossJoin(F.broadcast(numbers)).groupBy("slot", "term").agg(F.max(share).alias("most"), F.collect_list(one).alias("p"))  # slot rows at most
    blocks = blocks.select("term", "slot", "most", F.col("p.id").alias("ids"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens"))
    blocks.repartitionByRange("term", "slot").sortWithinPartitions("term", "slot").write.mode("overwrite").parquet(f"{path}/blocks")
    docs.sparkSession.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("ids")).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    numbers.withColumns({"k1": F.lit(float(k1)), "b": F.lit(float(b))}).write.mode("overwrite").parquet(f"{path}/numbers")


@dataclass
class Found:
    """(id, score) of the best documents, and how many of the terms' blocks and postings were read for them."""

    rows: DataFrame
    slots: DataFrame
    blocks: DataFrame

    def read(self) -> tuple[int, int]:
        """(postings read, postings of the query's terms)."""
        size = F.sum(F.size("ids"))
        return self.blocks.join(self.slots, "slot", "left_semi").agg(size).first()[0] or 0, self.blocks.agg(size).first()[0] or 0


def search(spark: SparkSession, path: str, query: str, limit: int, among: DataFrame | None = None, digits: int | None = None) -> Found:
    """The limit best documents by BM25, then id, of those whose ids are among some (its first column); weights are those of the whole index."""
    wanted = [r["t"] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query)))).alias("t")).collect()]  # the query's words
    numbers = spark.read.parquet(f"{path}/numbers").first()
    known = spark.read.parquet(f"{path}/terms").where(F.col("term").isin(wanted))
    weight = F.log(1 + (numbers["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = F.broadcast(known.select("term", weight.alias("idf")))  # a row for each of the query's words
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("term").isin(wanted))
    bounds = blocks.select("term", "slot", "most").join(weights, "term").groupBy("slot").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
    bounds = staged(bounds, "bounds")
    first = [r["slot"] for r in bounds.orderBy(F.desc("bound"), "slot").limit(max(FIRST, FIRST_EACH * limit)).collect()]
    k1, b, average = numbers["k1"], numbers["b"], numbers["avg"] or 1.0

    def scored(some: DataFrame) -> DataFrame:
        x = some.join(weights, "term").select("idf", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p")).select("idf", "p.ids", "p.tfs", "p.lens")
        part = F.col("idf") * F.col("tfs") * (k1 + 1) / (F.col("tfs") + k1 * (1 - b + b * F.col("lens") / average))
        out = x.groupBy(F.col("ids").alias("id")).agg(F.sum(part).alias("score"))
        if among is not None:
            out = out.join(among.select(F.col(among.columns[0]).alias("id")), "id", "left_semi")
        return out.withColumn("score", F.round("score", digits)) if digits is not None else out

    best = scored(blocks.where(F.col("slot").isin(first))).orderBy(*order()).limit(limit)
    floor = best.agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).first()
    reaches = F.lit(True)
    if floor["n"] == limit:
        slack = 10.0**-digits if digits is not None else 0.0
        reaches = F.col("bound") * (1 + ROUNDING) + slack >= floor["floor"]
    slots = bounds.where(reaches | F.col("slot").isin(first)).select("slot")
    few = slots.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    rows = scored(blocks.join(F.broadcast(slots) if few else slots, "slot", "left_semi"))
    return Found(rows.orderBy(*order()).limit(limit), slots, blocks)
