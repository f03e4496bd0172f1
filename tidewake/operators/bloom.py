"""A set of keys as bits that a scan can test: what surely isn't in it goes before any shuffle.

The set has one number of 64 bits for each key (a power of two of them, MOST_NUMBERS at
most), in which a key sets four bits. With a number for each key about one of a thousand
other keys passes; beyond MOST_NUMBERS more do, and what passes is joined as before, so
results never depend on it. The bits are put together by Spark and are a value of the
plan, of 32 MB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_NUMBERS, MOST_NUMBERS = 1 << 10, 1 << 22
#: Numbers that one row holds while they are put together.
SLICE = 1 << 10


def bits(h: Column) -> Column:
    """Four bits of a number, by the upper bits of a hash."""
    one = F.lit(1).cast("long")
    picked = [F.call_function("shiftleft", one, F.shiftrightunsigned(h, n).bitwiseAND(F.lit(63)).cast("int")) for n in (58, 51, 44, 37)]
    return picked[0].bitwiseOR(picked[1]).bitwiseOR(picked[2]).bitwiseOR(picked[3])


def place(h: Column, numbers: int) -> Column:
    return h.bitwiseAND(F.lit(numbers - 1)).cast("int")


class Bloom:
    """The keys in the first column of a table; null is no key."""

    def __init__(self, keys: DataFrame, count: int | None = None):
        spark, key = keys.sparkSession, keys.columns[0]
        keys = keys.select(F.xxhash64(key).alias("h")).where(F.col(key).isNotNull())
        n = keys.count() if count is None else count
        self.numbers = min(MOST_NUMBERS, max(LEAST_NUMBERS, 1 << n.bit_length()))
        used = keys.groupBy(place(F.col("h"), self.numbers).cast("long").alias("id")).agg(F.bit_or(bits(F.col("h"))).alias("b"))
        dense = spark.range(self.numbers).join(used, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
        in_order = lambda of, by, what: F.transform(F.array_sort(F.collect_list(F.struct(by, what))), lambda x: x[of])
        slices = dense.groupBy(F.floor(F.col("id") / SLICE).alias("slice")).agg(in_order("b", "id", "b").alias("part"))
        whole = slices.agg(F.flatten(in_order("part", "slice", "part")).alias("bits"))  # one row of 32 MB at most
        jvm = spark.sparkContext._jvm
        held = whole._jdf.first().getSeq(0).toArray(jvm.scala.reflect.ClassTag.Long())
        self._bits = Column(jvm.org.apache.spark.sql.functions.lit(held))

    def may_hold(self, key: Column) -> Column:
        """False where the key is surely not in the set, or null."""
        h = F.xxhash64(key)
        need = bits(h)
        return key.isNotNull() & (F.get(self._bits, place(h, self.numbers)).bitwiseAND(need) == need)
