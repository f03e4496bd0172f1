"""Snapshots of hashes by path, their differences, and what a sync needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import nul


def diff(previous: DataFrame, current: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, change): added, modified or removed; unchanged keys are left out."""
    p, c = previous.select(key, F.col(value).alias("_p"), F.lit(1).alias("_in_p")), current.select(key, F.col(value).alias("_c"), F.lit(1).alias("_in_c"))
    change = F.when(F.col("_in_p").isNull(), "added").when(F.col("_in_c").isNull(), "removed").when(~F.col("_p").eqNullSafe(F.col("_c")), "modified")
    return p.join(c, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def equal(previous: DataFrame, current: DataFrame, key: str = "path", value: str = "hash") -> bool:
    return diff(previous, current, key, value).isEmpty()


def digest(snapshot: DataFrame, config: str = "", group: str | None = None) -> DataFrame:
    """sha256 over the configuration and, in path order, path and hash, each closed by a NUL.

    One string per snapshot: for a snapshot of a codebase, whose file list is small beside its content.
    """
    entries = F.array_sort(F.collect_list(F.struct("path", "hash")))
    body = F.array_join(F.transform(entries, lambda e: F.concat(e["path"], nul(), e["hash"], nul())), "")
    out = F.sha2(F.concat(F.lit(f"config:{config}"), nul(), body), 256).alias("digest")
    return snapshot.groupBy(*([group] if group else [])).agg(out)


def fingerprints(documents: DataFrame, separator: Column | None = None) -> DataFrame:
    """(conversation_id, fingerprint): sha256 over the messages by index; fields closed by a NUL; blank ids are left out."""
    z = separator if separator is not None else nul()
    names = documents.columns
    tools = F.lit("")
    if "tools" in names:
        s = lambda c: F.coalesce(c, F.lit(""))
        tools = F.array_join(F.transform(F.coalesce("tools", F.array()), lambda t: F.concat(s(t["name"]), z, s(t["display"]), z, s(t["lang_hint"]), z, s(t["output"]), z, F.coalesce(t["is_error"], F.lit(False)).cast("string"), z)), "")
    thinking = F.coalesce("thinking", F.lit("")) if "thinking" in names else F.lit("")
    message = F.concat(F.col("message_index").cast("string"), z, F.coalesce("role", F.lit("")), z, F.coalesce("text", F.lit("")), z, tools, thinking, z)
    rows = documents.select(F.trim("conversation_id").alias("conversation_id"), F.struct("message_index", message.alias("m")).alias("x")).where("conversation_id != ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]), "")
    return rows.groupBy("conversation_id").agg(F.sha2(body, 256).alias("fingerprint"))


def needed(stored: DataFrame, manifest: DataFrame) -> DataFrame:
    """(conversation_id, change) of those whose documents the sender must deliver."""
    return diff(stored, manifest, "conversation_id", "fingerprint").where(F.col("change").isin("added", "modified"))


def forced(changes: DataFrame, current: DataFrame, ids: DataFrame, key: str = "path") -> DataFrame:
    """changes, and as modified the forced keys that exist and aren't among them."""
    more = current.select(key).join(ids.select(key).distinct(), key, "left_semi").join(changes.select(key), key, "left_anti")
    return changes.unionByName(more.select(key, F.lit("modified").alias("change")))


def rotated(rows: DataFrame, key: str, cursor: str, n: int) -> DataFrame:
    """The n keys after the cursor, from the start again where they end."""
    return rows.orderBy(F.col(key) <= F.lit(cursor) if cursor else F.lit(False), key).limit(n)


def capped_needed(changes: DataFrame, limit: int, cursor: str = "", key: str = "conversation_id") -> tuple[DataFrame, str]:
    """The keys to ask for now, and where to go on: modified ones first, added ones in what room is left."""
    added, modified = (changes.where(F.col("change") == c).select(key) for c in ("added", "modified"))
    if limit <= 0:
        return added.unionByName(modified).orderBy(key), cursor
    n = modified.limit(limit + 1).count()
    if n > limit:
        taken = rotated(modified, key, cursor, limit)
        return taken.orderBy(key), last_after(taken, key, cursor) or ""
    room = limit - n
    window = rotated(added, key, cursor, room) if room else None
    following = (last_after(window, key, cursor) if window is not None else None) or modified.agg(F.max(key)).first()[0] or ""
    return (modified.unionByName(window) if window is not None else modified).orderBy(key), following


def last_after(taken: DataFrame, key: str, cursor: str) -> str | None:
    """The last of some rotated keys."""
    row = taken.agg(F.max_by(key, F.struct(F.col(key) <= F.lit(cursor) if cursor else F.lit(False), key))).first()
    return row[0] if row else None


def renames(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, source) of new paths whose file is an old one by device, inode and hash; of several the first by name."""
    new = current.join(previous.select("path"), "path", "left_anti").where("inode is not null")
    old = previous.select(F.col("path").alias("source"), "hash", "device", "inode").where("inode is not null")
    return new.join(old, ["device", "inode", "hash"]).groupBy("path").agg(F.min("source").alias("source"))


def converge(batch: DataFrame, previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action, source) of the paths of a batch: remove, noop, copy or upsert.

    current has a row for every path that exists, with reason set if it may not be indexed.
    """
    sources = renames(previous, current.where("reason is null"))
    p = previous.select("path", F.col("hash").alias("_p"))
    c = current.select("path", F.col("hash").alias("_c"), "reason", F.lit(1).alias("_in"))
    rows = batch.select("path").distinct().join(p, "path", "left").join(c, "path", "left").join(sources, "path", "left")
    gone = F.col("_in").isNull() | F.col("reason").isNotNull()
    action = F.when(gone & F.col("_p").isNull(), "noop").when(gone, "remove").when(F.col("_p") == F.col("_c"), "noop").when(F.col("source").isNotNull(), "copy").otherwise("upsert")
    return rows.select("path", action.alias("action"), F.when(action == "copy", F.col("source")).alias("source"))


def captured(files: DataFrame, reason: Column | None = None) -> DataFrame:
    """(path, hash) of files (path, content) that pass the gates."""
    rows = files if reason is None else files.where(reason.isNull())
    return rows.select("path", F.sha2("content", 256).alias("hash"))


def latest(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(b) for b in by]))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")
