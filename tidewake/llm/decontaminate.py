"""Benchmark decontamination: a hash set of benchmark n-grams against every window of the documents.

The benchmark's windows (WINDOW consecutive words; a shorter item is one window of
its own) are hashed into a set of bits, about 64 bits and four of them set for each
window and MOST_BITS at most. The set is one value of the query, sent to every task, and
each document tests its own windows inside its row, without a shuffle. A word is
hashed once; the hash of two words is made of theirs, that of four words of two pairs,
and so on, so a window costs a few hashes whatever its length. What passes is verified
by its words against the benchmark's windows, which are broadcast only if there are at
most FEW of them; so the results are exact at every size, and a benchmark of more windows
than MOST_BITS has room for lets more windows through to the verification. The verified
windows give back the items and the words that are covered.

Defined results: null has no words; an item without words has no window; equal
windows of several items count for each of them; repeated rows each give their own
equal row; a very long text is scanned whole, in its row; an empty benchmark leaves every
document clean; an empty table gives an empty table; other columns of the documents are
left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import DIGEST, LOWER, UPPER, digested, let, table, without, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Benchmark windows that may be broadcast for the verification.
FEW = 200_000
#: Numbers of 64 bits that the set may have (32 MB), and how many of them are put in order at a time.
MOST_NUMBERS, CHUNK = 1 << 22, 1 << 12


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def combined(w: Column, sizes: list[int], body: Callable[[dict[int, Column]], Column]) -> Column:
    """body of {size: the hashes of all windows of that many words, by their place from 0}; behind the last window of a size the arrays hold other values."""
    def pairs(left: Column, right: Column, n: int) -> Column:
        return F.zip_with(left, F.slice(right, n + 1, F.size(right)), lambda a, b: F.xxhash64(a, b))

    def powers(known: dict[int, Column]) -> Column:
        most = max(known)
        if 2 * most <= max(sizes):
            return let(pairs(known[most], known[most], most), lambda h: powers(known | {2 * most: h}))
        return each(sizes, {}, known)

    def each(left: list[int], done: dict[int, Column], known: dict[int, Column]) -> Column:
        if not left:
            return body(done)
        parts = [n for n in sorted(known, reverse=True) if left[0] & n]
        h, size = known[parts[0]], parts[0]
        for n in parts[1:]:
            h, size = pairs(h, known[n], size), size + n
        return let(h, lambda x: each(left[1:], done | {left[0]: x}, known))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: powers({1: h}))


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(size, words, hash, items): every distinct window with the ids of its items, as strings."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(width))
    cut = items.select("item", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("w"))
    return cut.groupBy("size", F.array_join("w", " ").alias("words")).agg(F.first("w").alias("w"), F.collect_set("item").alias("items"))


def four_bits(h: Column) -> Column:
    """The bits of a hash within its number."""
    one = F.lit(1).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, F.shiftright(h, n).bitwiseAND(F.lit(63)).cast("int"))
    return bit(58).bitwiseOR(bit(52)).bitwiseOR(bit(46)).bitwiseOR(bit(40))


def bits_of(known: DataFrame, sizes: dict[int, int]) -> tuple[Column, int]:
    """The set of all windows as an array<long>, a value in the plan, and how many numbers it has, a power of two."""
    spark = known.sparkSession
    numbers = min(MOST_NUMBERS, max(CHUNK, 1 << sum(sizes.values()).bit_length()))
    hashes = None
    for n in sizes:
        own = known.where(F.col("size") == n).select(combined(F.col("w"), [n], lambda by: by[n][0]).alias("hash"))  # noqa: B023
        hashes = own if hashes is None else hashes.unionAll(own)
    used = hashes.select(F.col("hash").bitwiseAND(F.lit(numbers - 1)).alias("id"), four_bits(F.col("hash")).alias("bits")).groupBy("id").agg(F.bit_or("bits").alias("bits"))
    dense = spark.range(numbers).join(used, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    chunks = dense.groupBy(F.floor(F.col("id") / CHUNK).alias("chunk")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("part"))
    # numbers / CHUNK rows, 32 MB at most
    whole = chunks.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("bits"))
    jvm = spark.sparkContext._jvm
    value = whole._jdf.first().getSeq(0).toArray(jvm.scala.reflect.ClassTag.Long())
    return Column(jvm.org.apache.spark.sql.functions.lit(value)), numbers


def hits(w: Column, sizes: list[int], known: Column, numbers: int) -> Column:
    """array<struct<size, at, words>>: windows of the word array whose bits are in the set."""
    def passes(h: Column) -> Column:
        at = h.bitwiseAND(F.lit(numbers - 1))
        return let(four_bits(h), lambda need: known[at.cast("int")].bitwiseAND(need) == need)

    def of_size(size: int, h: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: passes(h[i - 1]))
        found = F.transform(at, lambda i: F.struct(F.lit(size).alias("size"), i.alias("at"), F.array_join(F.slice(w, i, F.lit(size)), " ").alias("words")))
        return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<struct<size:int,at:int,words:string>>"))

    return combined(w, sizes, lambda by: F.concat(*[of_size(n, by[n]) for n in sizes]))


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """docs without the text, with n_words, items (sorted strings) and covered (word numbers from 1), which replace own columns of these names."""
    known = written(windows(benchmark, width=width), "windows")
    sizes = {r["size"]: r["n"] for r in known.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each size up to width
    few = sum(sizes.values()) <= FEW
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "items", "covered")]
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*[F.col(c) for c in kept]).alias("row"), words(F.col(text_col)).alias("w"))
    if sizes:
        bits, numbers = bits_of(known, sizes)
        found = lambda w: hits(w, sorted(sizes), bits, numbers)
    else:
        found = lambda w: F.array().cast("array<struct<size:int,at:int,words:string>>")
    rows = rows.select("row_key", "row", let(F.col("w"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), found(w).alias("hits"))).alias("x"))
    rows = rows.select("row_key", "row", "x.n_words", F.posexplode_outer("x.hits").alias("nth", "hit"))
    known = known.select("size", "words", "items")
    # what a row carries goes with its first hit alone
    first = F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("row"))
    rows = rows.select("row_key", "n_words", first.alias("row"), F.col("hit.size").alias("size"), F.col("hit.words").alias("words"), F.col("hit.at").alias("at"))
    rows = rows.join(F.broadcast(known) if few else known, ["size", "words"], "left")
    spread = F.when(F.col("items").isNotNull(), F.sequence("at", F.col("at") + F.col("size") - 1))
    out = rows.groupBy("row_key").agg(F.first("row", ignorenulls=True).alias("row"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.array_distinct(F.flatten(F.collect_list(spread))).alias("covered"))
    return out.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "items", "covered")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("covered").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the covered words cut out of the text; what lies between words stays."""
    marked = scan(docs.select(F.struct("*").alias("original"), F.col(text_col).alias("text")), benchmark)
    own = F.col("original")[text_col]
    whole = F.coalesce(own, F.lit(""))
    pattern = WORD.replace("\\x60", "\\x40\\x5B-\\x60")  # the same words before lower-casing
    cut = F.array_join(F.zip_with(F.split(whole, pattern, -1), F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda w, i: F.when(F.array_contains(F.col("covered"), i + 1), F.lit("")).otherwise(w)), lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))), "")
    text = F.when(F.size("covered") > 0, cut).otherwise(own)
    return marked.select(*[(text if c == text_col else F.col("original")[c]).alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold a window of the benchmark, whatever their doc_id."""
    found = scan(digested(docs.select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return without(docs, found.where(F.size("covered") > 0).select("doc_id", DIGEST))


SQL = r"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item, least(len(w), 10) AS n, unnest(list_transform(range(1, CAST(len(w) - least(len(w), 10) + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0
), k AS (SELECT n, g, list(DISTINCT item) AS items FROM bw GROUP BY n, g
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (SELECT DISTINCT n FROM k
), p AS MATERIALIZED (
  SELECT doc_id, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - n + 2 AS BIGINT)), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, s WHERE len(w) >= n
), h AS MATERIALIZED (SELECT p.doc_id, p.i, p.n, k.items FROM p JOIN k USING (n, g)
), hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id
), hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, unnest(items) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
