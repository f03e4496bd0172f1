"""Files and messages as rows: splitting by bytes and lines, packing, putting together again."""

from __future__ import annotations

import bisect
import posixpath
import re
import shlex
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import message_path, part_index, thinking_path, tool_path
from ..functions.sizes import token_estimate
from . import folds
from .filters import storable

STORAGE_BYTES = 65_000
CHUNK_CHARS, OVERLAP_CHARS = 2500, 300
MAX_ROWS, MAX_TOKENS, INSERT_BYTES = 32, 6000, 192 * 1024 * 1024
BATCH_ROWS = 256


def byte_pieces(text: str, budget: int) -> list[tuple[str, int]]:
    """(piece, byte offset) of at most budget bytes each; a longer code point is a piece of its own."""
    data = text.encode("utf-8", "surrogatepass")
    if budget <= 0 or len(data) <= budget:
        return [(text, 0)]
    out, at = [], 0
    while at < len(data):
        end = min(at + budget, len(data))
        while at < end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append((data[at:end].decode("utf-8", "surrogatepass"), at))
        at = end
    return out


#: Pieces that are gathered before they are put to those before them, so that a long text's aren't copied for each.
GATHERED = 256


def split_bytes(text: Column, budget: Column | int) -> Column:
    """array<struct<content, offset>> as of byte_pieces; no text leaves the JVM, so a task holds one row's pieces. A null text has none."""
    limit = (budget if isinstance(budget, Column) else F.lit(budget)).cast("int")
    ints = F.array().cast("array<int>")

    def behind(data: Column, at: Column, n: Column) -> Column:
        """Where the piece that starts at a byte ends: where the last code point within the budget ends, or one that is longer."""
        starts = lambda k: ~F.substring(data, k + 1, F.lit(1)).between(F.lit(b"\x80"), F.lit(b"\xbf"))
        within = F.filter(F.array(*[at + n - i for i in range(4)]), lambda k: (k > at) & starts(k))
        beyond = F.filter(F.array(*[at + i for i in range(1, 5)]), starts)
        return F.least(F.coalesce(F.get(within, F.lit(0)), F.get(beyond, F.lit(0)), at + n), F.octet_length(data))

    def ends(data: Column, n: Column) -> Column:
        def one(x: Column) -> Column:
            end = behind(data, x["at"], n)
            return F.when(x["at"] < F.octet_length(data), F.transform(F.array(end), lambda e: F.struct(e.alias("at"), F.concat(x["ends"], F.array(e)).alias("ends")))[0]).otherwise(x)

        def some(x: Column) -> Column:
            start = F.struct(x["at"].alias("at"), ints.alias("ends"))
            got = F.aggregate(F.sequence(F.lit(1), F.lit(GATHERED)), start, lambda y, _: one(y))
            return F.when(x["at"] < F.octet_length(data), F.transform(F.array(got), lambda y: F.struct(y["at"].alias("at"), F.concat(x["ends"], F.array(y["ends"])).alias("ends")))[0]).otherwise(x)

        most = F.ceil(F.octet_length(data) / F.greatest(n - 3, F.lit(1)) / GATHERED).cast("int")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("ends"))
        return F.aggregate(F.sequence(F.lit(1), most), start, lambda x, _: some(x), lambda x: F.flatten(x["ends"]))

    def piece(content: Column, offset: Column) -> Column:
        return F.struct(content.cast("string").alias("content"), offset.cast("int").alias("offset"))

    def cut(data: Column) -> Column:
        from_to = F.transform(F.array(ends(data, limit)), lambda e: F.arrays_zip(F.concat(F.array(F.lit(0)), F.slice(e, F.lit(1), F.size(e) - 1)).alias("a"), e.alias("b")))[0]
        return F.transform(from_to, lambda x: piece(F.substring(data, x["a"] + 1, x["b"] - x["a"]), x["a"]))

    whole = F.array(piece(text, F.lit(0)))
    pieces = F.transform(F.array(text.cast("binary")), cut)[0]
    return F.when(text.isNotNull(), F.when((limit <= 0) | (F.octet_length(text) <= limit), whole).otherwise(pieces))


def split_rows(chunks: DataFrame, budget: int = STORAGE_BYTES) -> DataFrame:
    """chunks with content over the budget (what a store takes, unless a model takes less) split; split_part is the offset in the first parent plus one."""
    if budget <= 0:
        return chunks
    fits = F.octet_length("content") <= budget
    whole = chunks.where(fits | F.col("content").isNull())
    parts = chunks.where(~fits).withColumn("_p", F.explode(split_bytes(F.col("content"), budget)))
    base = F.when(F.col("split_part") > 0, F.col("split_part") - 1).otherwise(0)
    return whole.unionByName(parts.withColumn("split_part", (base + F.col("_p.offset") + 1).cast("int")).withColumn("content", F.col("_p.content")).drop("_p"))


def line_windows(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[str, int, int]]:
    """(content, first line, last line) of windows of whole lines of about size characters that overlap."""
    lines = text.splitlines(keepends=True)
    out, first = [], 0
    while first < len(lines):
        last, n = first, len(lines[first])
        while last + 1 < len(lines) and n + len(lines[last + 1]) <= size:
            last += 1
            n += len(lines[last])
        out.append(("".join(lines[first : last + 1]), first + 1, last + 1))
        if last + 1 >= len(lines):
            break
        back, n = last + 1, 0
        while back - 1 > first and n + len(lines[back - 1]) <= overlap:
            back -= 1
            n += len(lines[back])
        first = back
    return out


#: Lines that end what stands above them rather than begin something.
CLOSES = re.compile(r"\s*(?:[)\]}]|end\b|fi\b|done\b|esac\b|</)")
OPENS = re.compile(r"[(\[{]|[)\]}]")


def depths(lines: list[str]) -> list[int | None]:
    """How deep each line stands: by its indentation, or, if no line is indented, by the brackets open before it; None for lines that begin nothing (blank or closing ones)."""
    begins = [bool(x.strip()) and not CLOSES.match(x) for x in lines]
    wide = [len(x.expandtabs(4)) - len(x.expandtabs(4).lstrip()) for x in lines]
    if not any(w for w, ok in zip(wide, begins) if ok):
        wide, n = [], 0
        for x in lines:
            wide.append(n)
            for m in OPENS.finditer(x):
                n = max(0, n + (1 if m[0] in "([{" else -1))
    return [w if ok else None for w, ok in zip(wide, begins)]


def structure_pieces(text: str, size: int = CHUNK_CHARS) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of a text, of size characters at most each, which together are the text.

    A range of lines that is too long falls apart before each of its least deep lines, a part that is still too long in the same way, a line that is too long by characters; neighbours that fit together are then put together again.
    """
    lines = text.splitlines(keepends=True)
    deep, at = depths(lines), [0]
    for x in lines:
        at.append(at[-1] + len(x))
    stack, small = [(0, len(lines), False)] if lines else [], []
    while stack:
        a, b, headed = stack.pop()
        if at[b] - at[a] <= size:
            small.append((at[a], at[b]))
            continue
        if b - a == 1:
            small += [(k, min(k + size, at[b])) for k in range(at[a], at[b], size)]
            continue
        known = [d for d in deep[a + headed : b] if d is not None]
        least = min(known, default=None)
        cuts = [k for k in range(a + 1, b) if deep[k] is not None and deep[k] == least]
        if not cuts and least is not None and not headed:  # the one least deep line heads the rest
            stack.append((a, b, True))
            continue
        bounds = [a, *(cuts or [a + (b - a) // 2]), b]
        stack += [(x, y, False) for x, y in zip(bounds[-2::-1], bounds[:0:-1])]
    out: list[tuple[int, int]] = []
    for x, y in small:
        if out and y - out[-1][0] <= size:
            out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def structure_windows(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[str, int, int]]:
    """(content, first line, last line) of a text's pieces by structure, each with as many whole lines before it as fit into overlap and size."""
    at = [0]
    for x in text.splitlines(keepends=True):
        at.append(at[-1] + len(x))
    out = []
    for k, (start, end) in enumerate(structure_pieces(text, size)):
        least = max(start - overlap, end - size, 0) if k else start
        begin = bisect.bisect_left(at, least)
        first = at[begin] if k and at[begin] < start else start
        out.append((text[first:end], bisect.bisect_right(at, first), bisect.bisect_left(at, end)))
    return out


def file_chunks(files: DataFrame, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, windows: Callable[[str, int, int], list[tuple[str, int, int]]] = line_windows) -> DataFrame:
    """(path, content, start_line, end_line) of files (path, content); windows: line_windows or structure_windows."""
    @F.pandas_udf("array<struct<content:string,start_line:int,end_line:int>>")  # type: ignore[call-overload]
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"content": c, "start_line": a, "end_line": b} for c, a, b in windows(t or "", size, overlap)] for t in texts])

    return files.select("path", F.explode(run(F.col("content"))).alias("x")).select("path", "x.*").where(storable(F.col("content")))


#: Words of a shell that start no program.
SHELL_WORDS = {"if", "then", "elif", "else", "fi", "for", "while", "until", "do", "done", "case", "esac", "in", "{", "}", "!", "time", "function"}
ENDS_COMMAND = {";", ";;", "&", "&&", "|", "||", "|&", "(", ")", "\n"}
REDIRECTS = {"<": 0, ">": 1, ">>": 1, "&>": 1, "&>>": 1, ">|": 1, "<>": 0}


def shell_tokens(command: str) -> list[str]:
    """What a search should find of a shell command: its programs, then the files it reads, then those it writes.

    A file is named by its path below / and, if that differs, as it is written; one that needs the shell to be known only as written. A command that can't be read is its own token.
    """
    try:
        lexer = shlex.shlex(command.replace("\n", " ; "), posix=True, punctuation_chars=True)
        lexer.whitespace_split = True
        words = list(lexer)
    except ValueError:
        return [command.strip()]
    programs: list[str] = []
    files: tuple[list[str], list[str]] = ([], [])
    fresh, into = True, None
    for w in words:
        if w in REDIRECTS:
            into = REDIRECTS[w]
        elif into is not None:
            if not w.isdigit():
                known = not re.search(r"[$`*?\[~]", w)
                files[into].extend(dict.fromkeys([posixpath.normpath(posixpath.join("/", w)), w] if known else [w]))
            into = None
        elif w in ENDS_COMMAND:
            fresh = True
        elif fresh and w not in SHELL_WORDS and not re.match(r"[A-Za-z_]\w*=", w):
            programs.append(w)
            fresh = False
    found = [t for t in dict.fromkeys([*programs, *files[0], *files[1]]) if t.strip()]
    return found or [command.strip()]


def is_shell(tool: Column) -> Column:
    return F.coalesce((tool["lang_hint"] == "bash") & (F.trim(tool["display"]) != ""), F.lit(False))


def tool_text(tool: Column, shell: bool = True) -> Column:
    """Name, shell tokens and display of a tool call, trimmed, once each, by line; what it put out is left out. Shell commands leave the JVM; without shell, none does."""
    @F.pandas_udf("array<string>")  # type: ignore[call-overload]
    def run(commands: pd.Series) -> pd.Series:
        return commands.map(lambda c: shell_tokens(c) if c else [])

    none = F.array().cast("array<string>")
    tokens = F.coalesce(run(F.when(is_shell(tool), F.trim(tool["display"]))), none) if shell else none
    parts = F.concat(F.array(tool["name"]), tokens, F.array(tool["display"]))
    trimmed = F.transform(parts, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda x: x != "")), "\n")


def named_piece(name: Column, piece: Column, part: Column) -> Column:
    """Every piece but the first starts with the tool's name."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return F.when((part > 0) & (n != ""), F.concat(n, F.lit("\n"), piece)).otherwise(piece)


def message_rows(documents: DataFrame, budget: int) -> DataFrame:
    """(conversation_id, message_index, role, relative_path, content): text, tool output and thinking of each message, in pieces."""
    base = documents.withColumn("conversation_id", F.trim("conversation_id"))
    keys = ["conversation_id", "message_index", "role"]

    def pieces(rows: DataFrame, limit: Column) -> DataFrame:
        kept = rows.where(storable(F.col("_text"))).withColumn("_ps", split_bytes(F.col("_text"), limit))
        return kept.select("*", F.size("_ps").alias("_n"), F.posexplode("_ps").alias("_part", "_piece"))

    def path(at: Column) -> Column:
        return F.when(F.col("_n") > 1, F.concat_ws("/", at, F.col("_part").cast("string"))).otherwise(at)

    text = pieces(base.select(*keys, F.col("text").alias("_text")), F.lit(budget))
    out = text.select(*keys, path(message_path(F.col("conversation_id"), F.col("message_index"))).alias("relative_path"), F.col("_piece.content").alias("content"))
    if "tools" in documents.columns:
        calls, call = base.select(*keys, F.posexplode("tools").alias("_tool", "_call")), F.col("_call")
        tools = calls.where(is_shell(call)).withColumn("_text", tool_text(call)).unionByName(calls.where(~is_shell(call)).withColumn("_text", tool_text(call, shell=False)))
        size = F.octet_length(F.trim(F.coalesce(F.col("_call.name"), F.lit("")))) + 1
        limit = F.when((size > 1) & (F.lit(budget) > size), F.lit(budget) - size).otherwise(budget)
        rows = pieces(tools, limit)
        out = out.unionByName(rows.select(*keys, path(tool_path(F.col("conversation_id"), F.col("message_index"), F.col("_tool"))).alias("relative_path"), named_piece(F.col("_call.name"), F.col("_piece.content"), F.col("_part")).alias("content")))
    if "thinking" in documents.columns:
        rows = pieces(base.select(*keys, F.col("thinking").alias("_text")), F.lit(budget))
        out = out.unionByName(rows.select(*keys, path(thinking_path(F.col("conversation_id"), F.col("message_index"))).alias("relative_path"), F.col("_piece.content").alias("content")))
    return out


def reassembled(rows: DataFrame) -> DataFrame:
    """(conversation_id, message_index, role, text, has_derived) of the messages that stored rows belong to.

    Pieces go by the part in their path, recorded split positions first and by position, then by content. A message's own row tells its role before any other.
    """
    own = F.startswith("relative_path", F.lit("conv/"))
    split = F.col("split_part") if "split_part" in rows.columns else F.lit(None).cast("int")
    piece = F.struct(F.coalesce(part_index(F.col("relative_path"), F.col("conversation_id")), F.lit(0)).alias("p"), split.isNull().alias("unrecorded"), F.coalesce(split, F.lit(0)).alias("s"), F.col("content").alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(own, piece))), lambda x: x["c"]), "")
    role = F.coalesce(F.min_by("role", F.when(own, piece)), F.min("role"))
    return rows.groupBy("conversation_id", "message_index").agg(role.alias("role"), text.alias("text"), F.bool_or(~own).alias("has_derived"))


def packed(rows: DataFrame, key: str, seq: str, cost: Column, budget: int, max_rows: int | None = None) -> DataFrame:
    """rows with group: consecutive rows of each key whose costs stay within the budget, at most max_rows; a row over the budget is alone.

    Keys, places and costs alone are looked at, in parts that don't depend on keys (see folds); what else a row holds is joined by key and place. Rows of the same key and place go together.
    """
    costs = rows.select(key, seq, cost.cast("long").alias("_cost")).groupBy(key, seq).agg(F.coalesce(F.sum("_cost"), F.lit(0)).alias("_cost"), F.count(F.lit(1)).alias("_rows"))
    groups = folds.packed(costs, key, seq, budget, max_rows)
    groups = groups.select(F.col(key).alias("_key"), F.col(seq).alias("_seq"), "group")
    return rows.join(groups, F.col(key).eqNullSafe(F.col("_key")) & F.col(seq).eqNullSafe(F.col("_seq"))).drop("_key", "_seq")


def packed_by_tokens(rows: DataFrame, key: str, seq: str, reused: Column | None = None, max_rows: int = MAX_ROWS, tokens: int = MAX_TOKENS) -> DataFrame:
    """packed for embedding requests: a row whose vector is reused costs nothing."""
    cost = token_estimate(F.col("content"))
    return packed(rows, key, seq, cost if reused is None else F.when(reused, 0).otherwise(cost), tokens, max_rows)


def packed_by_bytes(rows: DataFrame, key: str, seq: str, size: Column, budget: int = INSERT_BYTES) -> DataFrame:
    return packed(rows, key, seq, size, budget)


class Rejected(Exception):
    """An embedder's answer that one input, or an unnamed one, is too long."""

    def __init__(self, index: int | None = None):
        super().__init__(f"input {index} is too long")
        self.index = index


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic unit vectors from hashed words, for tests and as a stand-in."""
    import hashlib
    import math
    import re

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimension
            for w in re.findall(r"\w+", t.lower()) or [t]:
                h = int.from_bytes(hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest()[:8], "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v] if any(v) else [1.0] + [0.0] * (dimension - 1))
        return out

    return embed


def embed_with_retry(texts: list[str], embed: Callable[[list[str]], list[list[float]]], floor: int = 1, lost: list[tuple[int, str, int]] | None = None) -> tuple[list[list[tuple[str, int, list[float]]]], int]:
    """For each text its pieces (piece, offset, vector), and how many pieces were dropped, which (text, piece, offset) are added to lost.

    A piece that is rejected as too long is halved and sent again; one that can't be halved, or has no more than floor bytes, is dropped. Blank texts are never sent.
    """
    done: list[list[tuple[str, int, list[float]]]] = [[] for _ in texts]
    waiting = [(i, t, 0) for i, t in enumerate(texts) if t.strip()]
    dropped = 0
    while waiting:
        try:
            vectors = embed([t for _, t, _ in waiting])
        except Rejected as e:
            if e.index is None and len(waiting) > 1:
                raise
            k = e.index or 0
            i, t, at = waiting.pop(k)
            size = len(t.encode("utf-8", "surrogatepass"))
            if len(t) <= 1 or size <= floor:
                dropped += 1
                if lost is not None:
                    lost.append((i, t, at))
            else:
                waiting[k:k] = [(i, p, at + o) for p, o in byte_pieces(t, max(size // 2, 1))]
            continue
        for (i, t, at), v in zip(waiting, vectors):
            done[i].append((t, at, v))
        break
    return done, dropped


def embedded_with_fate(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """embedded with every piece's fate: reused (had a vector), embedded, dropped (too long and can't be split) or refused (blank, never sent); the last two have no vector."""
    columns = [*chunks.columns, "fate"]
    schema = T.StructType([*chunks.schema.fields, T.StructField("fate", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = pdf.to_dict("records")
            for k in range(0, len(rows), BATCH_ROWS):
                some, lost = rows[k : k + BATCH_ROWS], []
                lack = [r for r in some if r["vector"] is None]
                found, _ = embed_with_retry([r["content"] or "" for r in lack], embed, lost=lost)
                out = [r | {"fate": "reused"} for r in some if r["vector"] is not None]
                for i, (r, pieces) in enumerate(zip(lack, found)):
                    base = int(r["split_part"]) - 1 if r["split_part"] == r["split_part"] and r["split_part"] else 0
                    gone = [(t, at) for j, t, at in lost if j == i]
                    if not pieces and not gone:
                        out.append(r | {"fate": "refused"})
                    for p, at, v in [*pieces, *((t, at, None) for t, at in gone)]:
                        part = base + at + 1 if len(pieces) + len(gone) > 1 or at else r["split_part"]
                        out.append(r | {"content": p, "vector": v, "split_part": part, "fate": "dropped" if v is None else "embedded"})
                yield pd.DataFrame(out, columns=columns)

    return chunks.mapInPandas(run, schema)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """chunks (with split_part and vector) embedded where they lack a vector; pieces that had to be split are rows of their own."""
    return embedded_with_fate(chunks, embed).where("vector is not null").drop("fate")


def fates(rows: DataFrame) -> DataFrame:
    """(fate, pieces, bytes) of embedded_with_fate, every fate also without pieces: what was refused is never counted as dropped."""
    every = rows.sparkSession.createDataFrame([(f,) for f in ("reused", "embedded", "dropped", "refused")], "fate string")
    counts = rows.groupBy("fate").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.octet_length("content")).alias("bytes"))
    zero = F.lit(0).cast("long")
    return every.join(counts, "fate", "left").select("fate", F.coalesce("pieces", zero).alias("pieces"), F.coalesce("bytes", zero).alias("bytes"))
