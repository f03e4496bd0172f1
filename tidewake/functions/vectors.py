"""Vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; an error if the sizes differ, null if a vector is."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return same_size(F.size(a), F.size(b), product)


def same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(a == b, value).when((a >= 0) & (b >= 0), F.raise_error(F.concat(F.lit("vectors of sizes "), a.cast("string"), F.lit(" and "), b.cast("string"))).cast("double"))


#: Up to so many numbers a product with a known vector is written out, which compiles; longer code wouldn't.
WRITTEN_OUT = 96


def dot_with(v: Column, known: Sequence[float]) -> Column:
    """dot with a vector that is known when the plan is made; the same sum in the same order."""
    if not 0 < len(known) <= WRITTEN_OUT:
        return dot(v, literal(known))
    total = F.lit(0.0)
    for i, x in enumerate(known):
        total = total + F.get(v, F.lit(i)).cast("double") * F.lit(float(x))
    return same_size(F.coalesce(F.size(v), F.lit(-1)), F.lit(len(known)), total)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for each row however often body uses it, also for each number of a vector."""
    return F.transform(F.array(value), body)[0]


def normalised(v: Column) -> Column:
    """The vector at length 1; an error if it is empty, zero or not finite."""
    def scaled(x: Column) -> Column:
        v, length = x["v"], x["length"]
        good = (F.size(v) > 0) & (length > 0) & ~F.isnan(length) & (length != float("inf"))
        return F.when(good, F.transform(v, lambda x: (x / length).cast("float"))).otherwise(F.raise_error(F.lit("vector must be finite and not zero")).cast("array<float>"))

    return let(v, lambda v: let(F.struct(v.alias("v"), norm(v).alias("length")), scaled))


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors that the mask keeps, at length 1."""
    def mean(kept: Column) -> Column:
        total = F.aggregate(F.slice(kept, F.lit(2), F.size(kept)), F.transform(kept[0], lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
        return F.transform(total, lambda x: x / F.size(kept))

    return normalised(let(F.filter(F.zip_with(tokens, mask, lambda v, m: F.when(m > 0, v)), lambda v: v.isNotNull()), mean))


def first_pooled(tokens: Column) -> Column:
    """The first token's vector at length 1."""
    return normalised(tokens[0])
