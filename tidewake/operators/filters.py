"""Predicates of searches: files by extension and subtree, messages by a filter record."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_extensions(extensions: Iterable[str]) -> list[str]:
    """Trimmed, without blanks, each with its dot."""
    out = [e.strip() for e in extensions]
    return [e if e.startswith(".") else f".{e}" for e in out if e]


def checked_extensions(extensions: Iterable[str]) -> list[str]:
    """clean_extensions, or an error that names those that can't be extensions."""
    out = clean_extensions(extensions)
    bad = [e for e in out if len(e) < 2 or any(c.isspace() for c in e)]
    if bad:
        raise ValueError(f"not file extensions: {', '.join(bad)}")
    return out


def has_extension(column: Column, extensions: Iterable[str]) -> Column | None:
    wanted = clean_extensions(extensions)
    return column.isin(wanted) if wanted else None


def under(path: Column, prefix: str) -> Column | None:
    """The path itself or what lies below it; no filter for the root."""
    p = prefix.strip().strip("/")
    return None if p in ("", ".") else (path == p) | F.startswith(path, F.lit(p + "/"))


def under_any(path: Column, prefixes: Iterable[str]) -> Column | None:
    parts = [c for p in prefixes if (c := under(path, p)) is not None]
    return reduce(or_, parts) if parts else None


def all_of(*clauses: Column | None) -> Column:
    """All clauses that are there; without any the whole table."""
    return reduce(and_, [c for c in clauses if c is not None], F.lit(True))


def code_filter(extensions: Sequence[str] = (), prefixes: Sequence[str] = (), path: str = "relative_path", extension: str = "file_extension") -> Column:
    return all_of(has_extension(F.col(extension), extensions), under_any(F.col(path), prefixes))


@dataclass
class ConversationFilter:
    """Empty lists, zeros and None let everything pass; ranges include their start only."""

    providers: list[str] = field(default_factory=list)
    workspace_roots: list[str] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    conversation_ids: list[str] = field(default_factory=list)
    parent_conversation_id: str = ""
    from_unix: int = 0
    until_unix: int = 0
    message_index_from: int = 0
    message_index_until: int = 0
    archived: bool | None = None
    min_score: float = 0.0

    def predicate(self) -> Column:
        """All but min_score, which applies after ranking. A null archived matches neither value."""
        c = F.col
        return all_of(
            c("provider").isin(self.providers) if self.providers else None,
            c("workspace_root").isin(self.workspace_roots) if self.workspace_roots else None,
            F.lower("role").isin([r.lower() for r in self.roles]) if self.roles else None,
            c("conversation_id").isin(self.conversation_ids) if self.conversation_ids else None,
            c("parent_conversation_id") == self.parent_conversation_id if self.parent_conversation_id else None,
            c("timestamp_unix") >= self.from_unix if self.from_unix > 0 else None,
            c("timestamp_unix") < self.until_unix if self.until_unix > 0 else None,
            c("message_index") >= self.message_index_from if self.message_index_from > 0 else None,
            c("message_index") < self.message_index_until if self.message_index_until > 0 else None,
            c("archived") == F.lit(self.archived) if self.archived is not None else None,
        )


def of_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the requested conversations with batch_id, the requested id they belong to.

    A row belongs to its own id, if that is requested, and else to the longest requested id that its path begins with, as conv/<id>/, convtool/<id>/ or convthink/<id>/; ids may hold slashes. Only the paths of rows without a requested id of their own are looked at.
    """
    wanted = ids.select("conversation_id").distinct()
    own = rows.join(wanted, "conversation_id", "left_semi").withColumn("batch_id", F.col("conversation_id"))
    rest = rows.join(wanted, "conversation_id", "left_anti")
    parts = F.split("relative_path", "/")
    kept = rest.where(F.get(parts, F.lit(0)).isin("conv", "convtool", "convthink") & (F.size(parts) > 2))
    begun = F.transform(F.sequence(F.lit(1), F.size(parts) - 2), lambda n: F.array_join(F.slice(parts, F.lit(2), n), "/"))
    found = kept.select("relative_path").distinct().select("relative_path", F.explode(begun).alias("batch_id")).join(wanted.withColumnRenamed("conversation_id", "batch_id"), "batch_id")
    best = found.groupBy("relative_path").agg(F.max_by("batch_id", F.length("batch_id")).alias("batch_id"))
    return own.unionByName(kept.join(best, "relative_path").select(own.columns))


def in_conversations(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of many conversations, by column or else by the paths of their messages."""
    return of_conversations(rows, ids).select(rows.columns)


def storable(text: Column) -> Column:
    """Whether a field has anything but white space, of which there is more than ASCII's."""
    return F.coalesce(F.regexp_like(text, F.lit(r"(?U)\S")), F.lit(False))


def needs_enrichment(workspace_root: Column, archived: Column) -> Column:
    return (F.coalesce(workspace_root, F.lit("")) == "") | archived.isNull()
