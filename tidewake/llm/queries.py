"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from . import chat_format, decontaminate, exact_dedup, fill_in_middle, html_text, language_id, ngram_join, packing, pii, resharding, toxicity, vector_codes, warc_zip

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_pii": pii.query,
    "op3_chat_format": chat_format.query,
    "op4_decontaminate": decontaminate.query,
    "op5_language_id": language_id.query,
    "op6_toxicity": toxicity.query,
    "op7_resharding": resharding.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_packing": packing.query,
    "op10_html_text": html_text.query,
    "op11_vector_codes": vector_codes.query,
    "op12_warc_zip": warc_zip.query,
    "op13_fill_in_middle": fill_in_middle.query,
}
ORACLES = {
    "op1_ngram_join": ngram_join.SQL,
    "op3_chat_format": chat_format.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_warc_zip": warc_zip.SQL,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
