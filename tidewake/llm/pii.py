"""Personal data: patterns propose spans, checksums confirm them, context words score them.

All in SQL functions. Each kind's pattern is run once per text; where it matches,
the text is split by the same pattern, and the lengths of the pieces and of the
matches give the offsets. Quantifiers of the base kinds are possessive and a match can
only begin where a run of its characters begins (or where the match before it ended),
which finds the same matches as the plain patterns in time linear in the text. The
pattern of iban tries the length of the country, so that a word after the number takes
no part; codes without a known length end where the longest run of capitals and digits
ends, at most 34 characters.

The base kinds (email, ip, card, phone) are kept as their patterns and checks
decide. The method adds kinds that a checksum or the context must confirm: iban
(mod 97) and ssn (needs a context word nearby). Every span carries a score:
the kind's prior, plus CONTEXT_GAIN if one of the kind's context words stands in
the CONTEXT_CHARS before it or after it, as far as its neighbours of the same kind.

Defined results: a null text is empty; an empty text has no spans; repeated rows
each give their own equal row; an empty table gives an empty table; columns of
the input beside the two that are named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Length of an account number by country, and of national numbers written the same way.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    of = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    other = f"(?!{'|'.join(' '.join(IBAN_LENGTHS.values()).split())})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}}"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*of, other])})(?![A-Za-z0-9])"


# The patterns of the contract, in the form described above.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
#: What a text must hold for a kind's pattern to be worth running.
NEEDS = {"email": "@", "phone": "+"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail|contact|write|adress|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|visa|credit|carte|tarjeta|karte",
    "phone": "phone|call|tel|mobile|fax|anruf",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
CONTEXT_CHARS, CONTEXT_GAIN, MIN_SCORE = 40, 0.3, 0.5
BLOCK = 512


def starts(pieces: Column, matches: Column) -> Column:
    """Where each match starts: sums over what lies before, by blocks so that long arrays stay cheap."""
    steps = F.zip_with(F.slice(pieces, 1, F.greatest(F.size(matches), F.lit(0))), matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))

    def running(items: Column, first: Column, step, value) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, x: F.struct((acc["at"] + step(x)).cast("int").alias("at"), F.concat(acc["out"], F.array((acc["at"] + value(x)).cast("int"))).alias("out"))
        return F.aggregate(items, zero, add, lambda acc: acc["out"])

    def from_steps(s: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda b: F.slice(s, b * BLOCK + 1, F.lit(BLOCK)))

        def from_blocks(blocks: Column) -> Column:
            sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["p"] + x["m"]))
            before = running(sums, F.lit(0), lambda x: x, lambda x: F.lit(0))
            return F.flatten(F.zip_with(blocks, before, lambda b, first: running(b, first, lambda x: x["p"] + x["m"], lambda x: x["p"])))

        return let(cuts, from_blocks)

    return let(steps, from_steps)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second one doubled."""
    def total(n: Column) -> Column:
        at = lambda i: F.substring(F.reverse(n), i, F.lit(1)).cast("int")
        values = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.when(i % 2 == 1, at(i)).otherwise(at(i) * 2 - F.when(at(i) >= 5, 9).otherwise(0)))
        return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0

    return let(number, total)


def mod97(iban: Column) -> Column:
    """Whether the remainder of the rearranged account number by 97 is 1."""
    def check(x: Column) -> Column:
        turned = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))
        values = F.transform(F.split(turned, ""), lambda c: F.when(c == "", None).when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
        return F.aggregate(values, F.lit(0), lambda acc, v: F.when(v.isNull(), acc).when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97)) == 1

    return let(F.regexp_replace(iban, " ", ""), check)


def small_parts(ip: Column) -> Column:
    significant = F.transform(F.split(ip, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(significant, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")).otherwise(999) <= 255))


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return small_parts(match)
    if kind == "card":
        return let(digits(match), lambda d: F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    return F.lit(True)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of one kind, in text order."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    pattern = PATTERNS[kind]

    def found(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)

        def located(p: Column) -> Column:
            rows = F.zip_with(F.zip_with(matches, starts(p, matches), lambda m, s: F.struct(m.alias("m"), s.alias("s"))), F.sequence(F.lit(1), F.size(matches)), lambda x, i: F.struct(x["m"].alias("m"), x["s"].alias("s"), F.lower(F.concat_ws(" ", F.right(F.get(p, i - 1), F.lit(CONTEXT_CHARS)), F.left(F.get(p, i), F.lit(CONTEXT_CHARS)))).alias("near")))
            rows = F.filter(rows, lambda x: valid(kind, x["m"]))
            rows = F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(F.regexp_like(x["near"], F.lit(rf"\b(?:{CONTEXT[kind]})")), CONTEXT_GAIN).otherwise(0.0)).alias("score")))
            return rows if kind in BASE else F.filter(rows, lambda x: x["score"] >= MIN_SCORE)

        return F.when(F.size(matches) > 0, let(pieces, located)).otherwise(empty)

    spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), spans).otherwise(empty) if kind in NEEDS else spans


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column pii: array<struct<kind, start, end, score>>, by kind, then start; an own column pii is replaced."""
    spans = let(F.coalesce(F.col(text_col), F.lit("")), lambda text: F.concat(*[spans_of(text, k) for k in BASE + ADDED]))
    return docs.withColumn("pii", spans)


def redacted(text: Column, pii: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first counts."""
    ordered = F.array_sort(F.transform(pii, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("out")))

    return F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    of = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: F.round(s["score"], 2).cast("string")), ",").alias("scores"))
