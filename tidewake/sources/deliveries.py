"""Deliveries that come in parts whose order matters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


class OutOfOrder(ValueError):
    """A part came where it may not."""


@dataclass
class Upsert:
    """A header, then documents, then one manifest."""

    header: dict[str, Any] | None = None
    documents: list[dict[str, Any]] = field(default_factory=list)
    manifest: dict[str, str] | None = None

    @classmethod
    def read(cls, parts: Iterable[tuple[str, Any]], keep: Callable[[list[dict[str, Any]]], None] | None = None) -> Upsert:
        """The delivery, or an error as soon as a part is out of order. keep: takes each batch of documents as it comes, such as a writer to a stage; only without it they are gathered here."""
        out, any_documents = cls(), False
        for kind, value in parts:
            if kind == "header":
                if out.header is not None or any_documents or out.manifest is not None:
                    raise OutOfOrder("the header comes first, and once")
                out.header = value
            elif out.header is None:
                raise OutOfOrder("the header comes first")
            elif kind == "documents":
                if out.manifest is not None:
                    raise OutOfOrder("documents come before the manifest")
                any_documents = True
                if keep is None:
                    out.documents += value
                else:
                    keep(value)
            elif kind == "manifest":
                if out.manifest is not None:
                    raise OutOfOrder("one manifest only")
                out.manifest = value
            else:
                raise OutOfOrder(f"unknown part: {kind}")
        if out.header is None or out.manifest is None:
            raise OutOfOrder("a header and a manifest are required")
        return out


@dataclass
class Enrichment:
    """A header that says whether it is a dry run, then entries."""

    dry_run: bool
    entries: list[tuple[str, str, bool]]

    @classmethod
    def read(cls, parts: Iterable[tuple[str, Any]]) -> Enrichment:
        head, entries = None, []
        for kind, value in parts:
            if kind == "header" and head is None and not entries:
                head = bool(value.get("dry_run"))
            elif kind == "entry" and head is not None:
                entries.append(tuple(value))
            else:
                raise OutOfOrder("one header, then entries")
        if head is None:
            raise OutOfOrder("a header is required")
        return cls(head, entries)


def staged(spark: SparkSession, path: str, schema: str) -> Callable[[list[dict[str, Any]]], None]:
    """For Upsert.read: appends each batch to the table at path, so the driver holds one batch at a time."""
    def keep(batch: list[dict[str, Any]]) -> None:
        if batch:
            spark.createDataFrame(batch, schema).write.mode("append").parquet(path)

    return keep
