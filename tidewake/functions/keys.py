"""Keys, names and paths of chunks and collections, as column expressions."""

from __future__ import annotations

import hashlib
import json
import re
from typing import Any
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

def nul() -> Column:
    return F.decode(F.unhex(F.lit("00")), "UTF-8")


def chunk_id(path: Column, start: Column, end: Column, content: Column, split_part: Column | None = None) -> Column:
    """chunk_ and 16 hex digits over path, lines, the part if above 0, and content."""
    plain = F.concat_ws(":", path, start.cast("string"), end.cast("string"), content)
    if split_part is not None:
        plain = F.when(split_part > 0, F.concat_ws(":", path, start.cast("string"), end.cast("string"), split_part.cast("string"), content)).otherwise(plain)
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(plain, 256), 1, 16))


def moved_id(new_path: Column, old_id: Column) -> Column:
    """The id of a row without a part number after its file moved."""
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", new_path, old_id), 256), 1, 16))


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


def catalog_key(content_hash: Column, model: Column) -> Column:
    return F.sha2(F.concat(content_hash, nul(), model), 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def provider(conversation_id: Column) -> Column:
    """What stands before the first colon; empty if there is none or it comes first."""
    return F.when(F.instr(conversation_id, ":") > 1, F.substring_index(conversation_id, ":", 1)).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def message_path(conversation_id: Column, message: Column, part: Column | None = None) -> Column:
    base = F.concat_ws("/", F.lit("conv"), conversation_id, message.cast("string"))
    return base if part is None else F.concat_ws("/", base, part.cast("string"))


def tool_path(conversation_id: Column, message: Column, tool: Column) -> Column:
    return F.concat_ws("/", F.lit("convtool"), conversation_id, message.cast("string"), tool.cast("string"))


def thinking_path(conversation_id: Column, message: Column) -> Column:
    return F.concat_ws("/", F.lit("convthink"), conversation_id, message.cast("string"))


def message_index(path: Column, conversation_id: Column) -> Column:
    """The message number in conv/<id>/<message>[/<part>]; null for anything else."""
    rest = F.split(F.substr(path, F.length(conversation_id) + 7, F.length(path)), "/")
    number = F.get(rest, F.lit(0))
    ok = F.startswith(path, F.concat(F.lit("conv/"), conversation_id, F.lit("/"))) & (F.size(rest) <= 2) & number.rlike("^[0-9]+$") & F.coalesce(F.get(rest, F.lit(1)), F.lit("0")).rlike("^[0-9]+$")
    return F.when(ok, number.try_cast("int"))


def part_index(path: Column, conversation_id: Column) -> Column:
    """The part number in conv/<id>/<message>/<part>; 0 without one, null if malformed."""
    rest = F.split(F.substr(path, F.length(conversation_id) + 7, F.length(path)), "/")
    return F.when(message_index(path, conversation_id).isNotNull(), F.coalesce(F.get(rest, F.lit(1)).try_cast("int"), F.lit(0)))


def family_path(path: Column) -> Column:
    """The path without the part: all parts of a message or tool output belong to one family."""
    parts = F.split(path, "/")
    keep = F.when(F.get(parts, F.lit(0)) == "convtool", 4).otherwise(3)
    return F.when(F.get(parts, F.lit(0)).isin("conv", "convtool", "convthink"), F.array_join(F.slice(parts, F.lit(1), keep), "/")).otherwise(path)


def collection_name(path: str, hybrid: bool = False, override: str = "", conversations: bool = False) -> str:
    """The name of a collection, at most 255 characters."""
    digest = hashlib.md5(path.encode()).hexdigest()[:8]
    if conversations:
        return f"conv_chunks_{digest}"
    prefix = "hybrid_code_chunks_" if hybrid else "code_chunks_"
    cleaned = re.sub(r"[^A-Za-z0-9]", "_", override)
    return f"{prefix}{cleaned[: 255 - len(prefix) - 9]}_{digest}" if cleaned else f"{prefix}{digest}"


def visible(name: Column) -> Column:
    """Collections that are not a stage or the rest of a swap."""
    return ~(F.endswith(name, F.lit("_stg")) | F.contains(name, F.lit("_swap_previous")))


def config_digest(config: dict[str, Any]) -> str:
    """sha256 of the configuration as JSON, without the digest of its ignore rules."""
    return hashlib.sha256(json.dumps(config | {"ignore_digest": ""}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def canonical_path(path: str) -> str:
    """An absolute path without . and ..; anything else is an error."""
    cleaned = (path or "").strip()
    if not cleaned:
        raise ValueError("path is required")
    if urlsplit(cleaned).scheme and "://" in cleaned:
        raise ValueError(f"a path, not a URI, is required: {cleaned}")
    if not cleaned.startswith("/"):
        raise ValueError(f"an absolute path is required: {cleaned}")
    out: list[str] = []
    for part in cleaned.split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out)


def subtree(root: str, path: str) -> str:
    """The part of path below root; empty for root itself."""
    root, path = canonical_path(root), canonical_path(path)
    if path == root:
        return ""
    if not path.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is not below {root}")
    return path[len(root.rstrip("/")) + 1 :]


def metadata_json(**fields: Column) -> Column:
    """The fields that are neither null nor empty as JSON; {} if all are."""
    kept = [F.when(c.cast("string") != "", c).alias(k) for k, c in fields.items()]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "true"})


def metadata_of(column: Column, schema: str) -> Column:
    """The fields of such JSON; all null if it can't be read."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def repair(data: bytes) -> str:
    """Bytes as text, each run of invalid bytes as one replacement character."""
    out, at, bad = [], 0, False
    while at < len(data):
        try:
            out.append(bytes(data[at:]).decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            if e.start:
                out.append(bytes(data[at : at + e.start]).decode("utf-8"))
                bad = False
            if not bad:
                out.append("\ufffd")
                bad = True
            at += e.start + 1
    return "".join(out)


def repaired(data: Column) -> Column:
    """repair of a column; valid bytes never leave the JVM's row."""
    @F.pandas_udf("string")  # type: ignore[call-overload]
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else repair(b))

    text = data.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(run(data))
