"""op12: archives, their splitting at every byte, revisits."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from feedlens.llm import warc
from feedlens.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"
ODD = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (1, "http://c/", "<p>one</p>"), (2, "http://b/", "other"), (4, "", None), (5, "x", ""), (-7, "y", ""),
    (6, "bad\r\nurl here", "é中😀\r\n\r\nWARC/1.1\r\n\r\n"), (7, "z", "w" * 3_000_000), (None, "n", "<p>one</p>"), (None, "n", "alone"), (None, "n", "twice"), (None, "m", "twice"), (8, "q", "\x00\x1f"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    first, out = {}, []
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    done = set()
    for i, _, h in rows:
        h = h or ""
        to = first.get(h)
        if to is not None and i == to and h not in done:
            done.add(h)
            to = None
        out.append((i, len(h.encode()), sha(h), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 6])
def test_page_records(spark, data, least):
    real = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    rows = ODD + [(100_000 + i, u, h) for i, u, h in real] + [(200_000 + i, "hot", "<p>hot</p>") for i in range(300)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("1 as digest", "*", "map('a', 1) as first", "'x' as size").repartition(7)
    got = warc.page_records(df, least_bytes=least).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, least)


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, QUERIES["op12_warc"](spark, data).collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert warc.page_records(spark.createDataFrame([], PAGES)).collect() == []


def scan(data, step, **k):
    return [r for lo in range(0, len(data), step) for r in warc.scan_range(io.BytesIO(data), len(data), lo, min(len(data), lo + step), **k)]


def test_every_split_finds_each_record_once():
    payloads = [b"<p>%d</p>" % i * (i * i) for i in range(12)] + [b"\x1f\x8b\x08\x00" * 50]
    data = b"".join(warc.member(i, "u", p, base64.b32encode(hashlib.sha1(p).digest()).decode()) for i, p in enumerate(payloads))
    whole = scan(data, len(data), keep=True)
    assert [r[-1] for r in whole] == payloads and all(r[-2] is None for r in whole)
    for step in (1, 7, 100, 333, len(data) - 1):
        assert scan(data, step, keep=True, piece=64) == whole


def test_foreign_and_broken_members():
    good = warc.member(1, "u", b"payload", sha("payload"))
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    lies = warc.member(2, "u", b"payload", sha("other"))
    broken = good[:-12] + bytes(4) + good[-8:]
    data = gzip.compress(b"no record") + good + b"junk\x1f\x8b\x08\x00junk" + info + lies + broken + good + good[:-9]
    got = scan(data, 50)
    assert [(r[2], r[4], r[6], r[-1] is None) for r in got] == [("response", 1, 7, True), ("warcinfo", None, 5, True), ("response", 2, 7, False), ("response", 1, None, False), ("response", 1, 7, True), ("response", 1, None, False)]
    assert scan(data, len(data)) == got


def test_archive_in_an_archive(spark, tmp_path):
    inner = warc.member(5, "in", b"inside", sha("inside"))
    block = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:9:x>\r\nContent-Type: application/gzip\r\nContent-Length: %d\r\n\r\n" % len(inner)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = stored.compress(block + inner + b"\r\n\r\n") + stored.flush()
    after = warc.member(6, "u", b"after", sha("after"))
    (tmp_path / "a.warc.gz").write_bytes(outer + after)
    files = warc.archives(spark, f"file://{tmp_path}")
    got = warc.read_warc(files, range_bytes=64)
    assert {r.page_id for r in got.collect()} == {5, 6, 9}
    assert {r.page_id for r in warc.drop_nested(got, range_bytes=64).collect()} == {6, 9}


def test_files_are_split_and_readable(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://p/{i}", f"page {i} " * 50) for i in range(200)], PAGES)
    path = f"file://{tmp_path}/out"
    warc.write_warc(df, path, file_bytes=2000)
    files = warc.archives(spark, path)
    assert files.count() > 8
    got = warc.read_warc(files, range_bytes=500, with_payload=True)
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect()} == {i: f"page {i} " * 50 for i in range(200)}
    one = sorted((tmp_path / "out").glob("*.gz"))[0]
    assert gzip.decompress(one.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    assert got.where(F.col("target_uri") == "http://p/3").count() == 1
