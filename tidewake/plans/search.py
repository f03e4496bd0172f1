"""The two searches, from a request to ranked rows, each as one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import subtree
from ..operators import blocks
from ..operators.filters import ConversationFilter, checked_extensions, code_filter
from ..operators.lexical import bm25, hybrid
from ..operators.retrieval import limit_of, order, scored, search, search_in, without_overlaps

Embedder = Callable[[list[str]], list[list[float]]]
OUTPUT = ("content", "relative_path", "start_line", "end_line", "file_extension", "metadata", "split_part", "workspace_root", "load_rules")
#: Above so many ids a search takes them as a table.
IDS = 256


def search_code(chunks: DataFrame, query: str, embed: Embedder, *, root: str = "/", path: str | None = None, extensions: Sequence[str] = (), limit: int | None = None, prefix: str = "", sparse: bool = False, index: str | None = None) -> DataFrame:
    """The best chunks of the subtree, without overlaps; prefix: the instruction before a query for dense search only.

    index: where blocks.write keeps the keyword index of all chunks, for sparse search; words are then weighed by the whole collection, without it by the chunks that pass the filter.
    """
    checked_extensions(extensions)
    where = code_filter(extensions, [subtree(root, path)] if path else [])
    kept, (vector,) = chunks.where(where), embed([prefix + query])
    if sparse:
        dense = scored(kept, vector).select("id", "score")
        if index:
            found = blocks.search(chunks.sparkSession, index, query, max(limit_of(limit), 10), among=kept.select("id")).rows
        else:
            found = bm25(kept, query)
        best = hybrid(dense, found, limit).join(kept, "id")
    else:
        best = search(kept, vector, limit=limit)
    ranks = best.withColumn("rank", F.row_number().over(Window.orderBy(*order())))  # limit rows
    out = without_overlaps(ranks, "relative_path")
    return out.select("id", "score", "rank", *[c for c in OUTPUT if c in chunks.columns]).orderBy("rank")


def search_conversations(chunks: DataFrame, query: str, embed: Embedder, filter: ConversationFilter | None = None, *, cap: int = 0, limit: int | None = None) -> DataFrame:
    """The best messages that pass the filter, at most cap of each conversation."""
    f = filter or ConversationFilter()
    (vector,) = embed([query])
    how = {"limit": limit, "group": "conversation_id", "cap": cap, "min_score": f.min_score}
    if len(f.conversation_ids) > IDS:
        ids = chunks.sparkSession.createDataFrame([(i,) for i in f.conversation_ids], "conversation_id string")
        rest = ConversationFilter(**{**f.__dict__, "conversation_ids": []})
        return search_in(chunks.where(rest.predicate()), ids, "conversation_id", vector, **how)
    return search(chunks, vector, where=f.predicate(), **how)


def search_conversation(chunks: DataFrame, manifest: DataFrame, conversation_id: str, query: str, embed: Embedder, limit: int | None = None) -> tuple[DataFrame, str | None]:
    """The best messages of one conversation, and the fingerprint it was indexed with."""
    row = manifest.where(F.col("conversation_id") == conversation_id).select("fingerprint").first()
    return search_conversations(chunks, query, embed, ConversationFilter(conversation_ids=[conversation_id]), limit=limit_of(limit)), row and row[0]
