"""Account numbers before capitalised and upper-case words, and next to each other."""

import pytest

from tidewake.llm import pii

DE, SPACED, GB = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
CASES = {
    f"IBAN {DE} The bank": [DE], f"{SPACED} The bank": [SPACED], f"IBAN {SPACED} THE BANK": [SPACED], f"IBAN {DE} {GB} USD 500": [DE, GB],
    f"iban {DE}": [DE], f"{GB}. Next": [GB], f"{DE}X and x{DE}": [], f"IBAN {DE[:-1]}1 The": [],
    "XX46370400440532013000 The": ["XX46370400440532013000"], "NO93 8601 1117 947 Oslo": ["NO93 8601 1117 947"], "MT84 MALT 0110 0001 2345 MTLC AST0 01S EUR": ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"],
}


def test_known_lengths():
    codes = " ".join(pii.IBAN_LENGTHS.values()).split()
    assert len(codes) == len(set(codes)) and all(len(c) == 2 for c in codes)


def test_words_after_a_number_take_no_part(spark):
    rows = [(t, want) for t, want in CASES.items()]
    df = spark.createDataFrame(rows, "text string, want array<string>")
    for r in pii.find(df).withColumn("safe", pii.redacted(pii.F.col("text"), pii.F.col("pii"))).collect():
        found = [r["text"][s["start"] : s["end"]] for s in r["pii"] if s["kind"] == "iban"]
        assert found == r["want"], r["text"]
        assert all(n not in r["safe"] for n in found)
