"""The operators made of SQL functions alone, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tidewake.llm import decontaminate, exact_dedup, pii, resharding

DOCS = "doc_id long, text string, lang string, keep_id long, run int, words string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", 7, 1, "x") for i, t in enumerate(texts)], DOCS)


# -- personal data ---------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


HARD = [
    None, "", "x", "a@b.c%d@e.f and é@q.com, mail: ü x.y+z@a-b.co.uk.", "1.2.3.4.5.6.7.8 999.1.1.1 0000001.2.3.004 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (980) 555-6268 +49 30 1234567 . +1 2 +++1234567890 +12345678901234567",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765433, ssn 078-05-1120 or social security 078-05-1121", "😀 a@b.cc 😀 +44 20 7946 0958 é",
    "a" * 60_000 + " " + "7" * 40_000 + " x@" + "y." * 9_000 + "z", " ".join(["4111111111111111 1.2.3.4"] * 1_500), "1 " * 30_000, "a@b.cc" * 3, "@.@", "+",
]


def test_pii_base_spans(spark):
    got = {r["doc_id"]: [tuple(s)[:3] for s in r["pii"]] for r in pii.find(docs_of(spark, HARD)).collect()}
    assert len(got) == len(HARD)
    for i, text in enumerate(HARD):
        assert [s for s in got[i] if s[0] in pii.BASE] == base_spans(text), i


def test_pii_added_kinds_and_redaction(spark):
    row = pii.find(docs_of(spark, [HARD[7]])).select("*", pii.redacted(pii.F.col("text"), pii.F.col("pii")).alias("safe")).first()
    assert [s["kind"] for s in row["pii"] if s["kind"] in pii.ADDED] == ["iban", "ssn", "ssn"]
    assert row["safe"].startswith("IBAN [IBAN] and ") and row["safe"].endswith("ssn [SSN] or social security [SSN]")


def test_pii_query_columns(spark, tmp_path):
    docs_of(spark, HARD * 2).write.parquet(f"{tmp_path}/documents.parquet")
    rows = pii.query(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(HARD)
    for r in rows:
        spans = base_spans((HARD * 2)[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        scores = [float(x) for x in r["scores"].split(",") if x]
        assert len(scores) == len(r["spans"].split(",") if r["spans"] else []) and all(0.5 <= x <= 1 for x in scores)
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in spans) for k in PLAIN]


def test_pii_empty_table(spark):
    assert pii.find(docs_of(spark, [])).count() == 0


# -- decontamination -------------------------------------------------------------------------


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def leaks(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        b = words_of(t)
        n = min(10, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


ITEMS = [(3, "One two THREE four five six seven eight nine ten eleven twelve"), (20, "Short item"), (7, None), (8, "?!"), (9, "short ITEM"), (100, "É ü one two three four five six seven eight nine ten"), (1, "a a a a a a a a a a a a")]
TEXTS = [None, "", "!!", "short item", "a short, item; and SHORT item", "One, two three four five six seven eight nine ten!", "é ü one two three four five six seven eight nine ten", "É ü one two three four five six seven eight nine ten eleven twelve", "a " * 30, "x " * 2000 + "short item", "one two three", "shortitem"]


@pytest.mark.parametrize(("few", "numbers", "chunk"), [(200_000, 1 << 23, 1 << 12), (0, 1, 1)])
def test_decontaminate_against_brute_force(spark, monkeypatch, few, numbers, chunk):
    """Also with a set of 64 bits, which lets most windows through to the verification."""
    monkeypatch.setattr(decontaminate, "FEW", few)
    monkeypatch.setattr(decontaminate, "MOST_NUMBERS", numbers)
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs_of(spark, TEXTS + TEXTS), bench).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        want = leaks((TEXTS + TEXTS)[r["doc_id"]], ITEMS)
        assert (r["n_words"], len(r["covered"]), r["items"]) == want
        assert (r["lang"], r["words"]) == ("en", "x")


def test_decontaminate_empty_inputs(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.scan(docs_of(spark, []), bench).count() == 0
    assert [len(r["covered"]) for r in decontaminate.scan(docs_of(spark, TEXTS), bench.limit(0)).collect()] == [0] * len(TEXTS)


def test_decontaminate_removes_spans(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs_of(spark, TEXTS), bench).collect()}
    assert got[4] == "a , ; and  " and got[10] == TEXTS[10] and got[0] is None
    assert not any(leaks(t, ITEMS)[1] for t in got.values())


# -- exact copies ----------------------------------------------------------------------------


def test_exact_dedup_against_brute_force(spark):
    texts = [None, "", "a  b", "a b", "a\tb", " a b", "x" * 50_000, "x" * 50_000, "a b"] + ["copy"] * 400 + [f"t{i}" for i in range(50)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", exact_dedup.F.lit(1))
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    got = Counter(tuple(r) for r in exact_dedup.dedup(df).collect())
    want = Counter()
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert got == want
    assert exact_dedup.dedup(df.limit(0)).count() == 0


def test_exact_dedup_stage_keeps_columns(spark):
    df = docs_of(spark, ["a", "a ", "a", "b", None])
    out = exact_dedup.stage(spark, df, "")
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == {0, 1, 3, 4}


# -- resharding ------------------------------------------------------------------------------


def test_flow_moves_the_fewest_bytes():
    flow = resharding.min_cost_flow([30, 30, 30], [22, 22, 22, 24])
    assert sum(flow.values()) == 90
    assert sum(x for (i, j), x in flow.items() if i != j) == 24
    assert resharding.min_cost_flow([], [0, 0]) == {} and resharding.min_cost_flow([5], [5]) == {(0, 0): 5}


def test_reshard_balances_and_fills_slots(spark):
    texts = [None, "", "é"] + ["w " * (i % 97) for i in range(4_000)] + ["same"] * 500
    df = docs_of(spark, texts)
    rows = resharding.reshard(df).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(size) == 16 and max(size.values()) - min(size.values()) <= 0.01 * max(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(size.values())
    moved = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    assert moved <= 0.3 * total  # four new shards of 16 need a quarter
    assert resharding.reshard(df.limit(0)).count() == 0


def test_rewrite_round_trip(spark, tmp_path):
    df = docs_of(spark, [f"text {i}" for i in range(300)])
    resharding.rewrite(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["text"] for r in back.select("text").collect()) == sorted(f"text {i}" for i in range(300))


def test_clashing_columns(spark):
    df = docs_of(spark, ["short item", "mail a@b.cc", None]).withColumns({c: pii.F.lit("own") for c in ("items", "covered", "original", "pii", "row", "w", "x", "at", "size", "hash", "block", "shard", "run", "place")})
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    cut = decontaminate.without_spans(df, bench)
    assert cut.columns == df.columns and {r["text"] for r in cut.collect()} == {" ", "mail a@b.cc", None} and cut.first()["items"] == "own"
    assert [len(r["covered"]) for r in decontaminate.scan(df, bench).orderBy("doc_id").collect()] == [2, 0, 0]
    assert [len(r["pii"]) for r in pii.find(df).orderBy("doc_id").collect()] == [0, 1, 0]
    assert resharding.reshard(df).count() == exact_dedup.dedup(df).count() == 3
