"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # type: ignore[return-value]


TOOL = "struct<name:string,display:string,lang_hint:string,output:string,is_error:boolean>"
CHUNK = "id string, content string, relative_path string, start_line int, end_line int, language string, file_extension string, split_part int, content_hash string, embedding_model string, vector array<float>"
CONVERSATION_COLUMNS = "conversation_id string, parent_conversation_id string, message_index int, role string, timestamp_unix bigint, workspace_root string, archived boolean, provider string, load_rules string"
CONVERSATION_CHUNK = f"{CHUNK}, {CONVERSATION_COLUMNS}"
DOCUMENT = f"conversation_id string, parent_conversation_id string, message_index int, role string, timestamp_unix bigint, text string, tools array<{TOOL}>, thinking string, workspace_root string, archived boolean, load_rules string"
MANIFEST = "conversation_id string, fingerprint string"
SNAPSHOT = "path string, hash string, device bigint, inode bigint"
CATALOG = "catalog_key string, content_hash string, model string, vector array<float>"
SAMPLE = "at timestamp, name string, unit string, value bigint, live boolean"
SPAN = "at timestamp, name string, span_id string, parent_span_id string, job_id string, duration_ms bigint"
JOB = "job_id string, codebase_id string, state string, started_at timestamp, completed_at timestamp, updated_at timestamp"
#: Metadata kept as JSON in a string beside each chunk.
METADATA = "language string, conversation_id string, parent_conversation_id string, message_index int, role string, timestamp_unix bigint, workspace_root string, archived boolean, load_rules string"
