"""Tables in buckets of a key's hash, of which a change rewrites the touched buckets alone.

A collection is a folder:

    data/<change>/bucket=<k>/...    Parquet files, never changed once they are written
    manifest/<version>.json         which folder holds each bucket, of one version

A change writes the buckets that it touches to a new folder and then one small manifest
that names these and, for all other buckets, the folders of the version before: writing
the manifest is the commit. A change that is cut off leaves a folder that no manifest
names; readers see the version before, and the next change goes on from there. Rows
read from a version stay readable while the next one is written; `vacuum` deletes what no
kept version names. A collection has one writer at a time: one that finds that another
has committed meanwhile stops with `Conflict`.

The manifest has an entry for each bucket, so the driver holds as many names as there are
buckets, whatever they hold; a lookup by key reads the buckets of its keys.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
#: Bytes that a bucket should hold; more make it slow to change, fewer make many files.
BUCKET_BYTES = 128 << 20
#: Versions that vacuum keeps.
KEPT = 2
#: Names of manifests.
VERSION = re.compile(r"(\d{12})\.json")
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another change was committed first."""


def buckets_for(size: int) -> int:
    """Buckets, a power of two, for size bytes."""
    return max(BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())


class Collection:
    """The collection in a folder; there need be none yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return sorted(int(m[1]) for n in names if (m := VERSION.fullmatch(n)))

    def manifest(self, version: int | None = None) -> dict | None:
        """key, buckets, schema, and folders: of each bucket that has rows; None: there is no collection."""
        known = self.versions()
        if not known:
            return None
        stream = self._fs.open(self._at(f"{self.path}/manifest/{version or known[-1]:012}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        out = json.loads(text)
        out["folders"] = {int(k): v for k, v in out["folders"].items()}
        return out | {"version": version or known[-1]}

    def exists(self) -> bool:
        return bool(self.versions())

    def _commit(self, manifest: dict, after: int) -> None:
        """Write the version that follows after; an error if there is one already."""
        folder, version = f"{self.path}/manifest", after + 1
        body = json.dumps({k: manifest[k] for k in ("key", "buckets", "schema", "folders")}).encode()
        waiting, final = self._at(f"{folder}/_{uuid.uuid4().hex}"), self._at(f"{folder}/{version:012}.json")
        out = self._fs.create(waiting, False)
        out.write(bytearray(body))
        out.close()
        if self._fs.exists(final) or (self.versions() or [0])[-1] != after or not self._fs.rename(waiting, final):
            self._fs.delete(waiting, False)
            raise Conflict(f"{self.path}: version {version} is there already")

    # -- reading ------------------------------------------------------------------------------

    def bucket(self, key: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        use = [f for k, f in sorted(manifest["folders"].items()) if buckets is None or k in set(buckets)]
        if not use:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in use])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows; None: there is no collection."""
        manifest = self.manifest(version)
        return None if manifest is None else self._rows(manifest)

    def in_buckets(self, buckets: Sequence[int], version: int | None = None) -> DataFrame | None:
        """The rows of some buckets; None: there is no collection."""
        manifest = self.manifest(version)
        return None if manifest is None else self._rows(manifest, buckets)

    def touched(self, keys: DataFrame, manifest: dict | None = None) -> list[int]:
        """The buckets of the keys, the first column of keys."""
        manifest = manifest or self.manifest()
        assert manifest is not None
        kind = T.StructType.fromJson(json.loads(manifest["schema"]))[manifest["key"]].dataType  # hashes differ by type
        found = keys.select(self.bucket(F.col(keys.columns[0]).cast(kind), manifest["buckets"]).alias(_BUCKET)).distinct()
        return sorted(r[0] for r in found.collect())  # a row for each bucket at most

    def of(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the buckets of some keys, which hold all rows of these keys and of some more."""
        manifest = self.manifest()
        return None if manifest is None else self._rows(manifest, self.touched(keys, manifest))

    # -- changing -----------------------------------------------------------------------------

    def _write(self, rows: DataFrame, key: str, buckets: int) -> dict[int, str]:
        """Write rows by bucket to a new folder; the folder of each bucket that has rows."""
        name = uuid.uuid4().hex
        path = f"{self.path}/data/{name}"
        marked = rows.withColumn(_BUCKET, self.bucket(F.col(key), buckets))
        # small buckets share a task, and a bucket that holds too much is split among several
        marked.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(path)
        if not self._fs.exists(self._at(path)):
            return {}
        found = (f.getPath().getName() for f in self._fs.listStatus(self._at(path)))
        return {int(n.partition("=")[2]): f"{name}/{n}" for n in found if n.startswith(f"{_BUCKET}=")}

    def create(self, rows: DataFrame, key: str, buckets: int = BUCKETS) -> None:
        """Make rows the whole collection, in place of what there was, in one commit."""
        after = (self.versions() or [0])[-1]
        folders = self._write(rows, key, buckets)
        self._commit({"key": key, "buckets": buckets, "schema": _schema(rows), "folders": folders}, after)
        self.vacuum()

    def rewrite(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Put change(rows) in place of the rows of the buckets of some keys (the first column); the buckets that were written.

        change gets all rows of these buckets and must leave those of other keys as they are; a row that it puts into a bucket that it didn't get is an error, and nothing is changed.
        """
        manifest = self.manifest()
        if manifest is None:
            raise LookupError(f"no collection: {self.path}")
        touched = self.touched(keys, manifest)
        if not touched:
            return []
        old = self._rows(manifest, touched)
        new = change(old)
        folders = self._write(new.select(old.columns), manifest["key"], manifest["buckets"])
        if stray := sorted(set(folders) - set(touched)):
            raise ValueError(f"rows of buckets {stray[:5]}, which the change didn't name")
        kept = {k: f for k, f in manifest["folders"].items() if k not in touched}
        self._commit(manifest | {"folders": kept | folders}, manifest["version"])
        self.vacuum()
        return touched

    def upsert(self, new: DataFrame, gone: DataFrame | None = None) -> list[int]:
        """Put new rows in place of those with their keys; rows of the keys in gone (first column) go too."""
        manifest = self.manifest()
        if manifest is None:
            raise LookupError(f"no collection: {self.path}")
        key = manifest["key"]
        keys = new.select(key) if gone is None else new.select(key).unionByName(gone.select(F.col(gone.columns[0]).alias(key)))
        keys = keys.distinct()
        return self.rewrite(keys, lambda old: old.join(keys, key, "left_anti").unionByName(new.select(old.columns)))

    def rebucketed(self, buckets: int) -> None:
        """Deal all rows out to another number of buckets."""
        manifest = self.manifest()
        if manifest is None:
            raise LookupError(f"no collection: {self.path}")
        self.create(self._rows(manifest), manifest["key"], buckets)

    def vacuum(self, keep: int = KEPT) -> int:
        """Delete the manifests before the last keep ones, and folders that none of those names; how many folders went."""
        known = self.versions()
        kept = known[-max(keep, 1) :]
        used = {f.partition("/")[0] for v in kept for f in self.manifest(v)["folders"].values()} if kept else set()
        buckets = {f for v in kept for f in self.manifest(v)["folders"].values()} if kept else set()
        for v in known[: -max(keep, 1)]:
            self._fs.delete(self._at(f"{self.path}/manifest/{v:012}.json"), False)
        folder, gone = self._at(f"{self.path}/data"), 0
        if not self._fs.exists(folder):
            return 0
        for change in self._fs.listStatus(folder):
            name = change.getPath().getName()
            if name not in used:
                gone += bool(self._fs.delete(change.getPath(), True))
                continue
            for part in self._fs.listStatus(change.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in buckets:
                    self._fs.delete(part.getPath(), True)
        return gone

    def drop(self) -> bool:
        return bool(self._fs.delete(self._at(self.path), True))


def _schema(rows: DataFrame) -> str:
    """The schema with every column nullable, as files have it."""
    return json.dumps(T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in rows.schema.fields]).jsonValue())
