"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what
it keeps, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents:

1. toxicity: documents that the model finds toxic go. The model learns from the labelled
   rows of `documents`, as in op6.
2. exact_dedup: of equal texts the row with the smallest doc_id stays.
3. near_dedup: of each group of near copies the document with the smallest doc_id stays.
4. decontaminate: documents that hold a window of `benchmark` go.
5. pack: the pieces of what is left, packed into sequences.

Defined results: stages decide on rows. A null text has no toxic word and no window of the
benchmark, counts as empty for exact copies and has no near copies; a null doc_id loses
against any other, rows of null ids alone stay, and so do rows that share the smallest
doc_id of a group; very long texts are read whole by every stage; columns beside doc_id and
text go through all stages but the last, whatever their names; an empty table gives no
sequences. What a stage wrote is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from tidewake.llm.common import forget_but_last, made, table, written

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", ngram_join.stage),
    ("decontaminate", decontaminate.stage),
    ("pack", packing.stage),
]

#: The trained model and the tokenizer can't be put in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`."""
    docs, since = table(spark, sf_dir, "documents"), len(made())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget_but_last(spark, since)
    return STAGES[-1][1](spark, docs, sf_dir)
