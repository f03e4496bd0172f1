"""Archives written by tasks, and archives made by other means, read back by ranges."""

import base64
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewake.llm import common, warc_zip

PAGES = "page_id long, url string, html string"
ROWS = [
    (None, None, None), (None, "http://a/b", None), (3, "http://a/b", "same"), (2, "http://b.example.org:80/x?y#z", "same"), (5, None, "same"), (None, "u", "same"), (7, "http://a/\r\nX-Page-Id: 1", "own\r\n\r\n"),
    (8, "", ""), (9, "ü é", "😀 é\x00\x1f\x8b"), (10, "big", "long " * 400_000), (11, "big", "long " * 400_000), (12, "x", "WARC/1.1\r\n\r\n"), (2**63 - 1, "x", "max"), (-(2**63), "x", "max"), (2**53 + 1, "x", "odd"), (2**53 + 3, "x", "odd"), (20, "r", "rep"), (20, "r", "rep"),
]


def b32(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def plain_loop(rows, least_bytes=0):
    least = {}
    for i, _, h in rows:
        h = h or ""
        least[h] = i if least.get(h) is None else least[h] if i is None else min(i, least[h])
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        first = len(data) < least_bytes or least[h or ""] is None or least[h or ""] == i
        out.append((i, len(data), b32(data), "response" if first else "revisit", None if first else least[h or ""]))
    return sorted(out, key=repr)


def written_to(spark, tmp_path, rows, parts=3, **how):
    return warc_zip.write(spark.createDataFrame(rows, PAGES).repartition(parts), f"file://{tmp_path}/archives", **how)


@pytest.mark.parametrize("most", [common.MOST_BROADCAST, 0])
@pytest.mark.parametrize("least_bytes", [0, 4])
def test_round_trip(spark, tmp_path, monkeypatch, most, least_bytes):
    monkeypatch.setattr(warc_zip, "MOST_BROADCAST", most)
    archives = written_to(spark, tmp_path, ROWS, least_bytes=least_bytes)
    got = warc_zip.read(archives).collect()
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "type", "refers_to")) for r in got), key=repr) == plain_loop(ROWS, least_bytes)
    assert all(r["problem"] is None for r in got)
    whole = warc_zip.resolved(warc_zip.read(archives)).collect()
    assert Counter((r["page_id"], bytes(r["payload"]).decode()) for r in whole) == Counter((i, h or "") for i, _, h in ROWS)
    urls = {r["page_id"]: r["url"] for r in got}
    assert urls[7] == "http://a/%0D%0AX-Page-Id: 1" and urls[9] == "ü é" and urls[5] is None and urls[8] == ""
    # other tools read the same files
    for r in archives.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
            data, index = z.read(warc_zip.WARC_MEMBER), [json.loads(x[x.index("{") :]) for x in z.read(warc_zip.INDEX_MEMBER).decode().splitlines()]
        assert len(index) == r["records"]
        for x in index:
            record = gzip.decompress(data[int(x["offset"]) : int(x["offset"]) + int(x["length"])])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and x["digest"].encode() in record


def test_many_archives_and_stretches(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 7}/{i}", "".join(rng.choices("abcdefgh ", k=rng.randrange(900)))) for i in range(700)]
    monkeypatch.setattr(warc_zip, "STRETCH", 5_000)
    archives = written_to(spark, tmp_path, rows, 4)
    assert archives.count() == 4
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in warc_zip.read(archives).collect()) == [(i, h) for i, _, h in rows]
    listed = warc_zip.archives_in(spark, f"file://{tmp_path}/archives")
    assert {(r["path"].rpartition("/")[2], r["length"]) for r in listed.collect()} == {(r["path"].rpartition("/")[2], r["length"]) for r in archives.collect()}
    assert warc_zip.read(listed, payloads=False).count() == 700


def test_an_archive_is_closed_when_full(tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_RECORDS", 3)
    a = warc_zip.Archive(f"file://{tmp_path}", "x.wacz")
    for k in range(3):
        assert not a.full()
        a.add(warc_zip.record(k, "u", b"p", None, True, "x")[0], "u", "d")
    assert a.full() and not (tmp_path / "x.wacz").exists()
    assert a.close()[2] == 3 and [p.name for p in tmp_path.iterdir()] == ["x.wacz"]


# -- archives made by other means ---------------------------------------------------------------


def plain_record(i, payload, kind="response", more=""):
    block = f"HTTP/1.1 200 OK\r\n\r\n{payload}".encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nX-Page-Id: {i}\r\n{more}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read_files(spark, tmp_path, files):
    rows = []
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        rows.append((f"{tmp_path}/{name}", len(data)))
    return warc_zip.read(spark.createDataFrame(rows, "path string, length long")).collect()


def zipped(members, comment=b"", method=zipfile.ZIP_STORED, **how):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in members.items():
            with z.open(zipfile.ZipInfo(name) if method == zipfile.ZIP_STORED else name, "w", **how) as m:
                m.write(data)
    return out.getvalue()


def test_archives_without_index_or_with_part_of_one(spark, tmp_path):
    texts = [f"page {i} " * i for i in range(40)]
    packed = [gzip.compress(plain_record(i, t)) for i, t in enumerate(texts)]
    plain = [plain_record(i, t) for i, t in enumerate(texts)]
    line = lambda name, at, n: f"k 2020 {json.dumps({'filename': name, 'offset': at, 'length': n})}\n".encode()
    files = {
        "a.zip": zipped({"archive/a.warc.gz": b"".join(packed), "note.txt": b"x"}),
        "b.zip": zipped({"archive/a.warc": b"".join(plain)}, comment=b"c" * 60_000),
        "c.zip": zipped({"archive/a.warc.gz": b"".join(packed), "indexes/i.cdxj": line("a.warc.gz", 0, len(packed[0]))}),
        "d.zip": b"#!/bin/sh\n" * 9 + zipped({"archive/a.warc": b"".join(plain), "indexes/i.cdxj.gz": gzip.compress(b"!meta\n" + line("a.warc", 0, len(plain[0]))), "archive/b.warc": b""}),
        "e.zip": zipped({"archive/a.warc": b"".join(plain)}, force_zip64=True),
        "f.zip": zipped({"archive/a.warc": b"".join(plain[:20]), "archive/b.warc.gz": b"".join(packed[20:])}),
    }
    got = read_files(spark, tmp_path, files)
    assert not [r for r in got if r["problem"]]
    for name in files:
        assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got if r["path"].endswith(name)) == list(enumerate(texts)), name


def wide_zip(members, count=None):
    """A ZIP64 archive made by hand: every size and place in the wide fields, also the directory's."""
    out, directory = b"", b""
    for name, data in members.items():
        crc, n = zipfile.crc32(data), len(name)
        header = len(out)
        out += b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, crc, 2**32 - 1, 2**32 - 1, n, 20) + name.encode() + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        directory += b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, crc, 2**32 - 1, 2**32 - 1, n, 4 + 2 + 28, 3, 0, 0, 0, 2**32 - 1)
        directory += name.encode() + struct.pack("<HH2s", 9, 2, b"??") + struct.pack("<HHQQQ", 1, 24, len(data), len(data), header) + b"abc"
    at = len(out)
    out += directory
    end = len(out)
    out += b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at) + b"PK\6\7" + struct.pack("<IQI", 0, end, 1)
    return out + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)


def test_zip64_directories(spark, tmp_path):
    many = {f"pages/{k}.txt": b"" for k in range(70_000)} | {"archive/a.warc": plain_record(1, "one")}
    got = read_files(spark, tmp_path, {"a.zip": wide_zip({"archive/x.warc": plain_record(5, "five"), "archive/y.warc.gz": gzip.compress(plain_record(6, "six"))}), "b.zip": zipped(many)})
    assert sorted((r["path"][-5:], r["page_id"], bytes(r["payload"]), r["problem"]) for r in got) == [("a.zip", 5, b"five", None), ("a.zip", 6, b"six", None), ("b.zip", 1, b"one", None)]


def test_broken_files_are_reported(spark, tmp_path):
    good = zipped({"archive/a.warc": plain_record(1, "x")})
    wrong = "WARC-Block-Digest: sha1:AAAA\r\n"
    files = {
        "empty.zip": b"", "text.zip": b"no archive " * 99, "cut.zip": good[:-30], "front.zip": good[40:], "flat.zip": zipped({"archive/a.warc": b"x" * 99}, method=zipfile.ZIP_DEFLATED),
        "length.zip": zipped({"archive/a.warc": b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx"}), "half.zip": zipped({"archive/a.warc.gz": gzip.compress(plain_record(1, "x"))[:-9]}),
        "digest.zip": zipped({"archive/a.warc": plain_record(1, "x", more=wrong)}), "payload.zip": zipped({"archive/a.warc": plain_record(1, "x", more="WARC-Payload-Digest: sha1:BBBB\r\n")}), "short.zip": zipped({"archive/a.warc": plain_record(1, "long text")[:-12]}), "odd.zip": zipped({"archive/a.warc": b"ABC\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"}),
        "good.zip": good,
    }
    got = {r["path"].rpartition("/")[2]: r["problem"] for r in read_files(spark, tmp_path, files)}
    assert set(got) == set(files)
    assert got.pop("good.zip") is None and all(got.values()), got


def test_clashing_names_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], PAGES).withColumns({c: F.lit("own") for c in ("key", "least", "first", "refers_to", "path", "at", "weight")})
    got = warc_zip.read(warc_zip.write(df, f"file://{tmp_path}/a")).collect()
    assert sorted((r["page_id"], r["refers_to"]) for r in got) == [(1, None), (2, 1)]
    none = warc_zip.write(df.limit(0), f"file://{tmp_path}/b")
    assert none.count() == 0 and warc_zip.read(none).count() == 0
