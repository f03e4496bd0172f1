"""Fill-in-middle transformation by injected markers, in SQL functions alone.

A delimiter is escaped in the text, so that it occurs nowhere; `regexp_replace` puts it
after each unit (a line with its end, or what is left behind the last end); the number of
delimiters is the number of units. With the units of the prefix and of prefix and middle
drawn from a hash of the identifier, `substring_index` takes the units of each part by
their rank, and the delimiters go and the escapes are undone. The parts are then put
together with sentinels, in one of two orders:

* psm: <P>prefix<S>suffix<M>middle
* spm: <S>suffix<P>prefix<M>middle

or stay as they are (plain): empty texts, texts that hold a sentinel themselves, and the
share of texts that `rate` leaves out. `restored` takes an output apart again.

Each row is changed for itself: no shuffle, nothing is held but the row.

Defined results: a null text counts as empty and is plain; a null identifier draws as an
empty one would; rows that repeat an identifier draw alike; a very long text is cut as a
whole; texts may hold the delimiter and the escape; equal rows each give a row; an empty
table gives an empty table; other columns of the input go through only if they are named in
keep, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: How a text is put together.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
#: A unit: a line with its end, or what is left.
UNIT = r"[^\n]*\n|[^\n]+"
#: The injected delimiter, and the escape that frees texts of it.
MARK, ESCAPE = "\x1e", "\x1b"


def swapped(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    """text without MARK: the escape is doubled up with e, the mark becomes the escape and d."""
    return swapped(swapped(text, ESCAPE, ESCAPE + "e"), MARK, ESCAPE + "d")


def unescaped(text: Column) -> Column:
    """The text of a run of marked units: the injected marks go before the escaped ones come back."""
    return swapped(swapped(swapped(text, MARK, ""), ESCAPE + "d", MARK), ESCAPE + "e", ESCAPE)


def draw(hashed: Column, k: int) -> Column:
    """The k-th group (from 0) of eight hexadecimal digits, as an unsigned integer."""
    return F.conv(F.substring(hashed, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output, keep) of every row; the parts are null if form is plain.

    n: how many units; rate: how many of 100 texts are transformed; spm_rate: how many of 100 of these as spm.
    """
    own = F.struct(*keep) if keep else F.lit(None).cast("boolean")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), hashed.alias("hashed"), own.alias("own"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + MARK))
    rows = rows.withColumn("n", (F.length("marked") - F.length(swapped(F.col("marked"), MARK, ""))).cast("long"))
    cuts = [F.pmod(draw(F.col("hashed"), k), F.col("n") + 1).cast("int") for k in (0, 1)]
    rows = rows.withColumns({"low": F.least(*cuts), "high": F.greatest(*cuts)})
    holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | holds | (draw(F.col("hashed"), 2) % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(draw(F.col("hashed"), 3) % 100 < spm_rate, "spm").otherwise("psm"))

    def units(x: Column | str, k: Column) -> Column:
        """The first k units, or the last -k."""
        return F.call_function("substring_index", x if isinstance(x, Column) else F.col(x), F.lit(MARK), k)

    # counted from the right there is one part more, the empty one behind the last mark
    ranked = {
        "prefix": units("marked", F.col("low")),
        "middle": units(units("marked", F.col("high")), F.col("low") - F.col("high")),
        "suffix": units("marked", F.col("high") - F.col("n").cast("int") - 1),
    }
    rows = rows.withColumns({k: F.when(F.col("form") != "plain", unescaped(v)) for k, v in ranked.items()})
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"), *[F.col("own")[c].alias(c) for c in keep])


def restored(output: Column, form: Column) -> Column:
    """The text that output was made of: sentinels occur in no transformed text, so the first of each is the one put in."""
    def between(start: str, end: str | None) -> Column:
        rest = F.substring(output, F.instr(output, start) + len(start), F.length(output))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    made = made.withColumn("again", restored(F.col("output"), F.col("form")))
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("again", 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS w, len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(w[1:lo], '') AS prefix, array_to_string(w[lo + 1:hi], '') AS middle, array_to_string(w[hi + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
