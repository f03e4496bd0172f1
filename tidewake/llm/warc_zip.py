"""WARC records in ZIP archives: written by tasks, read back by ranges.

An archive is a ZIP file with stored (uncompressed) members: a WARC whose records are one
gzip member each, and an index (CDXJ) of the records' offsets and lengths. Writing: each
task streams its rows into archives of its own, a new one whenever one is large enough, and
hands over a row for each finished archive; what a lost or repeated task left behind is in
no such row. Of rows with equal payloads the one with the smallest page_id becomes a
response, the others are revisits of it, which carry headers alone.

Reading, without extracting anything: the end of an archive and its central directory, in
their ZIP64 forms too, say where members lie; the index says where records lie, and where
there is none, or one that doesn't cover the whole member, the member is walked through
record by record. Ranges, a few numbers for each record, are dealt out by archive and
stretch of STRETCH bytes, so a large archive is read by many tasks, and each task reads
its ranges in order, neighbouring ones at once. Files are opened by pyarrow's file systems
from the archives' addresses.

Defined results: null html is an empty payload, null url a record without address; a null
page_id loses against any other, and rows of null ids alone are all responses, as are rows
that share the smallest page_id of their payload; equal rows each give a record; a long
payload is one record, held by its task alone; control characters in a url are written as
%XX; an empty table gives no archives and no records; other columns play no part. A file
that is no ZIP archive, or is cut off, an encrypted or compressed WARC member, and a record
that can't be parsed or doesn't have its digests give a row with `problem`.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, made, met, partitions, small_batches, table, tidily, work_dir, written

#: An archive is closed once it has so many bytes or records; its index is held until then.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 65_536
#: Ranges of one archive that lie in one stretch are read by one task, at most AT_ONCE bytes at a time.
STRETCH, AT_ONCE, CHUNK = 8 << 20, 4 << 20, 1 << 20
#: Payloads of fewer bytes are always responses.
LEAST_BYTES = 0
#: Names and formats of the archive's members and of records.
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Signatures and fields of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address and the path there."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


# -- writing ----------------------------------------------------------------------------------


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*what: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(what).encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def sort_key(url: str) -> str:
    """The url with its host's labels turned round, as indexes sort them."""
    m = re.fullmatch(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#:]*)(?::\d+)?([^#]*).*", url, re.S)
    return f"{','.join(reversed(m[1].lower().split('.')))}){m[2] or '/'}".replace(" ", "%20") if m else "-"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, first: bool, unique: str) -> tuple[bytes, str]:
    """A record's bytes and its payload's digest; first: it is a response, otherwise it refers to that of page refers_to."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first else http
    fields = [("WARC-Type", "response" if first else "revisit"), ("WARC-Record-ID", record_id(digest, page_id) if first else record_id(digest, page_id, url, unique)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if not first:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(digest, refers_to)), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Truncated", "length")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n", digest


class Archive:
    """One archive that is being written; it has its name once it is closed."""

    def __init__(self, folder: str, name: str):
        self.fs, at = system(folder)
        self.address, self.path, self.waiting = f"{folder}/{name}", f"{at}/{name}", f"{at}/.{name}.part"
        self.out = self.fs.open_output_stream(self.waiting)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.warc = self.zip.open(WARC_MEMBER, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, data: bytes, url: str | None, digest: str) -> None:
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = pack.compress(data) + pack.flush()
        self.warc.write(data)
        about = {"url": url or "", "mime": "text/html", "status": "200", "digest": f"sha1:{digest}", "length": str(len(data)), "offset": str(self.size), "filename": WARC_MEMBER.rpartition("/")[2]}
        self.lines.append(f"{sort_key(url or '')} {re.sub('[^0-9]', '', DATE)} {json.dumps(about)}\n")
        self.size += len(data)

    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES or len(self.lines) >= ARCHIVE_RECORDS

    def close(self) -> tuple[str, int, int]:
        """(address, bytes, records) of the finished archive."""
        self.warc.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as index:
            for line in sorted(self.lines):
                index.write(line.encode("utf-8", "surrogatepass"))
        self.zip.close()
        self.out.close()
        self.fs.move(self.waiting, self.path)
        return self.address, self.fs.get_file_info(self.path).size, len(self.lines)


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, html, first, refers_to) of every row: first: it becomes a response."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = pages.withColumn("key", F.when(F.octet_length("html") >= least_bytes, F.sha2("html", 256)))
    copies = keyed.where("key is not null").groupBy("key").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("weight")).where("weight > 1")
    copies = written(copies, "copies")
    if copies.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:  # pages stay where they are
        rows = keyed.join(F.broadcast(copies.drop("weight")), "key", "left")
    else:
        rows = met(keyed, copies, ["key"], copies.agg(F.sum("weight")).first()[0], "left")
    first = F.col("least").isNull() | F.col("least").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "html", first.alias("first"), F.when(~first, F.col("least")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives to folder and return their (path, length, records)."""
    spark = pages.sparkSession
    small_batches(spark)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, finished = None, []
        for batch in batches:
            columns = [batch.column(i).cast(pa.binary()) if i == 2 else batch.column(i) for i in range(5)]
            for page_id, url, html, first, refers_to in zip(*(c.to_pylist() for c in columns)):
                if archive is None:
                    archive = Archive(folder, f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz")
                if url is not None:
                    url = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
                data, digest = record(page_id, url, html, refers_to, first, f"{archive.path} {archive.size}")
                archive.add(data, url, digest)
                if archive.full():
                    finished.append(archive.close())
                    archive = None
        if archive is not None:
            finished.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in finished], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "length", "records"])

    return written(decided(pages, least_bytes).mapInArrow(tidily(run), "path string, length long, records long"), "archives")


# -- reading ----------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    encrypted: bool
    size: int
    header: int


def read_at(file: BinaryIO, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if at < 0 or len(data) < size:
        raise ValueError("cut off")
    return data


def members(file: BinaryIO, length: int) -> Iterator[Member]:
    """The members in an archive's central directory, which is read piece by piece."""
    tail = read_at(file, max(0, length - 22 - FULL16), min(length, 22 + FULL16))
    first, at = length - len(tail), tail.rfind(END)
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no ZIP archive")
    count, size, begin = struct.unpack_from("<HII", tail, at + 10)
    end = first + at
    if (count == FULL16 or size == FULL32 or begin == FULL32) and end >= 20 and (locator := read_at(file, end - 20, 20)).startswith(LOCATOR64):
        end = struct.unpack_from("<Q", locator, 8)[0]
        head = read_at(file, end, 56)
        if not head.startswith(END64):
            raise ValueError("no ZIP64 directory where it should be")
        count, size, begin = struct.unpack_from("<QQQ", head, 32)
    before = end - size - begin  # bytes in front of the archive
    if before < 0:
        raise ValueError("cut off")
    begin += before
    buffer, at, stop = b"", begin, begin + size
    while count:
        need = 46
        if len(buffer) >= 46:
            need += sum(struct.unpack_from("<HHH", buffer, 28))
        if len(buffer) < need:
            got = read_at(file, at, min(max(CHUNK, need), stop - at))
            if not got:
                raise ValueError("the directory ends early")
            buffer, at = buffer + got, at + len(got)
            continue
        if not buffer.startswith(CENTRAL):
            raise ValueError("no directory entry where it should be")
        flags, method = struct.unpack_from("<HH", buffer, 8)
        packed, plain, n_name, n_extra = struct.unpack_from("<IIHH", buffer, 20)
        header = struct.unpack_from("<I", buffer, 42)[0]
        name, extra = buffer[46 : 46 + n_name], buffer[46 + n_name : 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # in this order, those that don't fit
                wide = list(struct.unpack_from(f"<{min(n, len(extra) - 4) // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == FULL32 and wide else plain
                packed = wide.pop(0) if packed == FULL32 and wide else packed
                header = wide.pop(0) if header == FULL32 and wide else header
            extra = extra[4 + n :]
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), method, bool(flags & 1), packed, header + before)
        buffer, count = buffer[need:], count - 1


def start_of(file: BinaryIO, member: Member) -> int:
    """Where the bytes of a member begin."""
    head = read_at(file, member.header, 30)
    if not head.startswith(LOCAL):
        raise ValueError("no member where it should be")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


def stretches(file: BinaryIO, at: int, size: int) -> Iterator[bytes]:
    for k in range(at, at + size, CHUNK):
        yield read_at(file, k, min(CHUNK, at + size - k))


def lines_of(file: BinaryIO, at: int, size: int, packed: bool) -> Iterator[bytes]:
    unpack, rest = zlib.decompressobj(31) if packed else None, b""
    for data in stretches(file, at, size):
        while data:
            more, data = (unpack.decompress(data), b"") if unpack else (data, b"")
            if unpack and unpack.eof:
                unpack, data = zlib.decompressobj(31), unpack.unused_data
            *lines, rest = (rest + more).split(b"\n")
            yield from lines
    if rest:
        yield rest


def indexed(file: BinaryIO, at: int, size: int, packed: bool) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of the records in an index."""
    for line in lines_of(file, at, size, packed):
        found = line[line.find(b"{") :]
        if found.startswith(b"{"):
            about = json.loads(found)
            if {"filename", "offset", "length"} <= about.keys():
                yield about["filename"].rpartition("/")[2], int(about["offset"]), int(about["length"])


def walked(file: BinaryIO, at: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of a WARC without an index; of gzip members, each is one."""
    first = 0
    if size and read_at(file, at, min(2, size)) == b"\x1f\x8b":
        unpack, done = zlib.decompressobj(31), 0
        for data in stretches(file, at, size):
            done += len(data)
            while data:
                unpack.decompress(data)
                data = unpack.unused_data
                if unpack.eof:
                    yield first, done - len(data) - first
                    first, unpack = done - len(data), zlib.decompressobj(31)
        if first < size:
            raise ValueError("a record is cut off")
        return
    while first < size:
        head = b""
        while b"\r\n\r\n" not in head and first + len(head) < size:
            head += read_at(file, at + first + len(head), min(4096, size - first - len(head)))
        found = re.search(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", head[: head.find(b"\r\n\r\n") + 4], re.I)
        if not found:
            raise ValueError("a record without length")
        n = head.find(b"\r\n\r\n") + 4 + int(found[1]) + 4
        yield first, min(n, size - first)
        first += n


RANGES = "path string, at long, size long, problem string"


def located(archives: DataFrame) -> DataFrame:
    """(path, at, size, problem) of every record of archives (path, length): where it lies in the file."""
    def ranges(path: str, length: int) -> Iterator[tuple[int | None, int | None, str | None]]:
        fs, name = system(path)
        with fs.open_input_file(name) as file:
            held, found = [], {}
            for m in members(file, length):
                if re.search(r"\.(warc|cdxj?)(\.gz)?$", m.name, re.I):
                    held.append(m)
            for m in held:
                if m.method or m.encrypted:
                    if ".warc" in m.name.lower():
                        yield None, None, f"{m.name}: {'encrypted' if m.encrypted else 'compressed'}"
                elif ".warc" not in m.name.lower():
                    for warc, at, size in indexed(file, start_of(file, m), m.size, m.name.endswith(".gz")):
                        found.setdefault(warc, set()).add((at, size))
            for m in held:
                if m.method or m.encrypted or ".warc" not in m.name.lower():
                    continue
                start, records, end = start_of(file, m), sorted(found.get(m.name.rpartition("/")[2], ())), 0
                for at, size in records:
                    if at != end:
                        break
                    end = at + size
                for at, size in records if end == m.size else walked(file, start, m.size):
                    yield start + at, size, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "at", "size", "problem"])

        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                try:
                    for r in ranges(path, length):
                        rows.append((path, *r))
                        if len(rows) == 10_000:
                            yield packed(rows)
                            rows = []
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    rows.append((path, None, None, str(e)))
                yield packed(rows)

    return archives.select("path", "length").mapInArrow(tidily(run), RANGES)


class Record(NamedTuple):
    type: str | None
    record_id: str | None
    url: str | None
    page_id: int | None
    refers_to: int | None
    refers_to_record: str | None
    payload_bytes: int | None
    payload_digest: str | None
    payload: bytes | None
    problem: str | None


def parsed(data: bytes) -> Record:
    """A record from its bytes; a revisit has the length and digest of the payload that it refers to, not its bytes."""
    try:
        if data.startswith(b"\x1f\x8b"):
            data = zlib.decompress(data, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("no record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        kind, size = fields["warc-type"], int(fields["content-length"])
        if len(rest) < size:
            raise ValueError("cut off")
        block, problem = rest[:size], None
        number = lambda k: int(fields[k]) if k in fields else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
            problem = "the block has another digest"
        http, end, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
        if kind == "revisit":
            found = re.search(rb"\r\ncontent-length:[ \t]*(\d+)", http, re.I)
            n, payload = int(found[1]) if found else None, None
        else:
            n, own = len(payload), base32_sha1(payload)
            problem = problem or ("the payload has another digest" if digest not in (None, own) else None)
            digest = own
        return Record(kind, fields.get("warc-record-id"), fields.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"), fields.get("warc-refers-to"), n, digest, payload, problem)
    except (ValueError, KeyError, zlib.error) as e:
        return Record(*[None] * 9, f"{type(e).__name__}: {e}"[:200])


COLUMNS = {
    "type": ("string", pa.string()), "record_id": ("string", pa.string()), "url": ("string", pa.string()), "page_id": ("long", pa.int64()), "refers_to": ("long", pa.int64()),
    "refers_to_record": ("string", pa.string()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "payload": ("binary", pa.binary()), "problem": ("string", pa.string()),
}


def together(ranges: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Runs of ranges of one file that follow each other, of AT_ONCE bytes at most or one range."""
    path, run = "", []
    for p, at, size in ranges:
        if run and (p != path or at != run[-1][0] + run[-1][1] or at + size - run[0][0] > AT_ONCE):
            yield path, run
            run = []
        path = p
        run.append((at, size))
    if run:
        yield path, run


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (path, length) with their path and place there; payloads: with the payloads' bytes."""
    spark = archives.sparkSession
    total = archives.agg(F.sum("length")).first()[0] or 0
    use = {k: v for k, v in COLUMNS.items() if payloads or k != "payload"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ranges() -> Iterator[tuple[str, int, int]]:
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

        opened, file = "", None
        for path, found in together(ranges()):
            if path != opened:
                if file is not None:
                    file.close()
                fs, name = system(path)
                opened, file = path, fs.open_input_file(name)
            first, rows = found[0][0], []
            data = memoryview(read_at(file, first, found[-1][0] + found[-1][1] - first))
            for at, size in found:
                rows.append(parsed(bytes(data[at - first : at - first + size])))
            arrays = [pa.array([path] * len(found), pa.string()), pa.array([at for at, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array([getattr(r, k) for r in rows], kind) for k, (_, kind) in use.items()], ["path", "at", *use])
        if file is not None:
            file.close()

    schema = "path string, at long, " + ", ".join(f"{k} {kind}" for k, (kind, _) in use.items())
    ranges = written(located(archives.repartition(partitions(spark), "path")), "ranges")
    # by a number of its own: the ranges are small, what they stand for is not
    tasks = max(partitions(spark), -(-total // (4 * STRETCH)))
    dealt = ranges.where("problem is null").repartition(tasks, "path", F.floor(F.col("at") / STRETCH)).sortWithinPartitions("path", "at")
    records = dealt.select("path", "at", "size").mapInArrow(tidily(run), schema)
    broken = ranges.where("problem is not null").select("path", "at", *[(F.col("problem") if k == "problem" else F.lit(None).cast(kind)).alias(k) for k, (kind, _) in use.items()])
    return records.unionByName(broken)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the archives in a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path", "length")


def resolved(records: DataFrame) -> DataFrame:
    """records with the payload of every revisit taken from the record that it refers to."""
    own = records.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.first("payload").alias("found"))
    revisits = records.where("type = 'revisit'").join(own, "refers_to_record", "left")
    return records.where("type is null or type != 'revisit'").unionByName(revisits.withColumn("payload", F.col("found")).select(*records.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    made().append(folder)
    records = read(write(table(spark, sf_dir, "pages"), folder), payloads=False)
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("a record was not read back: "), "problem"))).otherwise(F.col("type"))
    return records.select("page_id", "payload_bytes", "payload_digest", checked.alias("record_type"), "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS least,
         array_to_string(list_transform(list_transform(range(8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)), lambda v:
           array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> s) % 32 + 1, 1)), '')), '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN least IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN least IS DISTINCT FROM page_id THEN least END AS refers_to
FROM d
"""
