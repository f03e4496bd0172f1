"""Sizes in bytes and tokens, and what they decide."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of a model's token limit that is used, and bytes for each of its tokens (5 / 2).
TOKEN_SHARE, BYTES_NUMERATOR, BYTES_DENOMINATOR = 0.9, 5, 2
#: Token limits of the embedding models by name, and of presets that run offline.
MODEL_TOKENS = {"baai/bge-small-en-v1.5": 512, "nvidia/nv-embedcode-7b-v1": 4096}
PRESET_TOKENS = {"embeddinggemma": 2048, "bge-small": 512}
LEAST_TOKENS = 512
FILE_BYTES = 2 * 1024 * 1024
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def token_estimate(text: Column) -> Column:
    """A token for every four bytes begun, at least one."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 3) / 4).cast("int"))


def model_tokens(model: str = "", offline: bool = False) -> int:
    """Tokens that an input may have; of an unknown model the least of the known limits."""
    known = PRESET_TOKENS if offline else MODEL_TOKENS
    return known.get(model.strip().lower(), LEAST_TOKENS)


def embed_byte_budget(model: str = "", configured_tokens: int = 0, offline: bool = False) -> int:
    """Bytes of text that surely fit the model; a configured limit can only tighten it."""
    tokens = int(model_tokens(model, offline) * TOKEN_SHARE)
    if configured_tokens > 0:
        tokens = min(tokens, configured_tokens)
    return tokens * BYTES_NUMERATOR // BYTES_DENOMINATOR


def row_bytes(dimension: int, *text: Column) -> Column:
    """What a row takes in an insert: its texts and four bytes for each number of the vector."""
    total = F.lit(4 * dimension)
    for t in text:
        total = total + F.coalesce(F.octet_length(t), F.lit(0))
    return total


def clamped_int(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(INT_MIN)), F.lit(INT_MAX)).cast("int")


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def backoff_ms(attempt: int, status: int, attempts: int = 4) -> int | None:
    """How long to wait before the next attempt; None: give up."""
    return 200 * 2 ** (attempt - 1) if status in (429, 503) and attempt < attempts else None


def rejected_input(message: str) -> dict[str, int] | None:
    """The numbers in an embedder's message that an input is too long."""
    found = {k: re.search(p, message) for k, p in (("index", r"input(?:\[| )(\d+)"), ("limit", r"max(?:imum)?\D{0,40}(\d+)"), ("tokens", r"(?:resulted in|got|has) (\d+) tokens"))}
    return {k: int(m[1]) for k, m in found.items() if m} or None
