"""WARC archives: one gzip member a record, and a reader that splits files at any byte.

The writer gives every page a record. Of pages with equal payloads one holds it
(response), the others name that one (revisit). The reader deals byte ranges of
the archives to tasks. A task scans its range for the gzip magic, decodes what
follows each candidate, takes it for a member only if a whole WARC header comes
out, and owns the records that start inside its range, however far they reach
beyond it. The payload is hashed while it is decoded, so a record's size costs no memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, fresh_dir, map_batches, parts, settle

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]")  # gzip, deflate, no reserved flag
_END = b"\r\n\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_name(page_id: int | None, digest: str, copy: int | str) -> str:
    """A record's id; rows that repeat an id and a payload are numbered from the second, those without an id by task and place."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{f':{copy}' if copy else ''}>"


def _page_of(name: str | None) -> int | None:
    found = re.match(r"<urn:page:(-?\d+)[:>]", name or "")
    return int(found[1]) if found else None


def member(page_id: int | None, url: str | None, payload: bytes, digest: str, *, copy: int | str = 0, refers_to: int | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> bytes:
    """One record as a gzip member: a response with the payload, or with ``refers_to`` a revisit of that page's record.

    A revisit keeps the HTTP head of its capture, so the length of the payload that it leaves out stays known.
    """
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_name(page_id, digest, copy)), ("WARC-Date", date)]
    if url:
        fields.append(("WARC-Target-URI", _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_name(refers_to, digest, 0))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    text = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return packer.compress(text) + packer.compress(block) + packer.compress(_END) + packer.flush()


def plan_records(pages: DataFrame, *, least_bytes: int = 0, heavy: int = 1000) -> DataFrame:
    """The rows of (page_id, url, html) with their payload's digest, dealt by page and payload, each after what is known of its payload.

    Returns (page_id, url, html, digest, first). A row whose html is null is a
    mark: ``first`` is the smallest page_id of all rows of that payload, and the
    rows of the same page and payload follow it. Only payloads of at least
    ``least_bytes`` bytes that several rows have are marked. They are grouped
    by SHA-1 and length before any text moves, and texts are shuffled once. A
    payload with more than one in ``heavy`` of all rows would be one task of a
    join: there are fewer than ``heavy`` of those, so they are broadcast. Rows
    without page_id carry ``first`` themselves.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").alias("size"))
    narrow = rows.select("page_id", "digest", "size")
    groups = narrow.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = settle(groups.where("n > 1 and first is not null"), "payloads")
    (total,) = narrow.agg(F.count("*")).first()
    large = F.col("n") * heavy > total
    often, rest = groups.where(large).drop("n"), groups.where(~large).drop("n")

    def with_first(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        told = df.join(F.broadcast(often), ["digest", "size"], "left")
        return told.where("first is not null"), told.where("first is null").drop("first")

    many, few = with_first(narrow.where("page_id is not null"))
    marks = many.unionByName(few.join(rest, ["digest", "size"])).dropDuplicates(["page_id", "digest"])
    own, other = with_first(rows.where("page_id is null"))
    nameless = own.unionByName(other.join(rest, ["digest", "size"], "left"))
    columns = ["page_id", "url", "html", "digest", "first"]
    empty = F.lit(None)
    named = rows.where("page_id is not null").withColumn("first", empty.cast("long"))
    marks = marks.withColumns({"url": empty.cast("string"), "html": empty.cast("string")})
    every = named.select(*columns).unionByName(marks.select(*columns)).unionByName(nameless.select(*columns))
    spread = F.when(F.col("page_id").isNull(), F.xxhash64("url"))
    return every.repartition("page_id", "digest", spread).sortWithinPartitions("page_id", "digest", F.col("html").isNotNull(), "url")


def write_warc(pages: DataFrame, path: str, *, least_bytes: int = 0, file_bytes: int = 256 << 20, level: int = 6) -> None:
    """Write a record for each row of (page_id, url, html) to ``*.warc.gz`` files of about ``file_bytes`` below ``path``.

    Runs at once. The payload is the html in UTF-8; a null counts as empty. Of rows with equal payloads
    (of ``least_bytes`` or more) that with the smallest page_id is a response,
    the others revisit it; of rows that repeat page_id and payload the first is the response. A row without page_id revisits as well; where no row of a payload has
    an id, all are responses. A null or empty url leaves its field out, control
    characters and blanks in one are percent-encoded. Other columns are ignored.
    A task writes under a name of its own and renames whole files, in an order
    that the rows fix, so that an attempt which is lost or runs twice leaves the same files.
    """

    def write(batches: Iterator[pa.RecordBatch]):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        part, written, out, temp = 0, 0, None, ""
        last, copy, known = None, 0, None

        def close():
            out.close()
            fs.move(temp, f"{root}/part-{task:06d}-{part:06d}.warc.gz")

        for batch in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, digest) != last:
                    last, copy, known = (page_id, digest), -1, None
                if html is None:
                    known = first
                    continue
                copy += 1
                if page_id is None:
                    revisits, copy_name = first, f"{task}-{copy}"
                else:
                    revisits, copy_name = (known if known is not None and (page_id != known or copy) else None), copy
                if out is None:
                    temp = f"{root}/part-{task:06d}-{part:06d}.{attempt}.tmp"
                    out, written = fs.open_output_stream(temp), 0
                record = member(page_id, url, html.encode(), base32_sha1(digest), copy=copy_name, refers_to=revisits, level=level)
                out.write(record)
                written += len(record)
                if written >= file_bytes:
                    close()
                    out, part = None, part + 1
        if out is not None:
            close()
            part += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([part], pa.int64())})

    arrow_map(plan_records(pages, least_bytes=least_bytes), write, "files long").agg(F.sum("files")).first()


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the archives below a folder; nothing of them is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return found.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "length")


class _Window:
    """Bytes of a file from a place on, read in pieces; what lies behind is let go."""

    def __init__(self, src, start: int, size: int, piece: int):
        self.src, self.size, self.piece = src, size, piece
        self.start, self.data = start, b""
        src.seek(start)

    @property
    def end(self) -> int:
        return self.start + len(self.data)

    def more(self) -> bool:
        new = self.src.read(min(self.piece, self.size - self.end)) if self.end < self.size else b""
        self.data += new
        return bool(new)

    def go(self, at: int) -> None:
        """Nothing before ``at`` is needed any more; it may lie behind what was let go."""
        if not self.start <= at <= self.end:
            self.start, self.data = at, b""
            self.src.seek(at)
        elif at - self.start > self.piece:
            self.data, self.start = self.data[at - self.start :], at


def _fields(text: bytes) -> dict[str, str] | None:
    """The named fields of a WARC header, lower-cased; None if it isn't one."""
    lines = text.split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        return None
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    good = {"warc-type", "warc-record-id", "content-length"} <= out.keys() and out["content-length"].isdigit()
    return out if good else None


class _Member:
    """Decodes the gzip member that may begin at a place of the window."""

    def __init__(self, view: _Window, at: int, most_head: int = 1 << 20):
        self.view, self.at, self.most = view, at, most_head
        self.inflate = zlib.decompressobj(31)
        self.fed = at
        self.broken: zlib.error | None = None

    def _next(self, limit: int) -> bytes:
        """Up to ``limit`` more decoded bytes; empty at the end of the member or of the file."""
        while not self.inflate.eof:
            if self.inflate.unconsumed_tail:
                got = self.inflate.decompress(self.inflate.unconsumed_tail, limit)
            elif self.fed < self.view.end or self.view.more():
                lo = self.fed - self.view.start
                chunk = self.view.data[lo : lo + (1 << 16)]
                self.fed += len(chunk)
                self.view.go(self.fed)
                got = self.inflate.decompress(chunk, limit)
            else:
                return self.inflate.decompress(b"", limit)  # what was decoded but didn't fit
            if got:
                return got
        return b""

    def header(self) -> tuple[dict[str, str], bytes] | None:
        """(fields, decoded bytes after them), or None where no record begins."""
        held = b""
        try:
            while (cut := held.find(_END)) < 0:
                if held and not VERSION[:7].startswith(held[:7]) or len(held) > self.most:
                    return None
                got = self._next(4096)
                if not got:
                    return None
                held += got
        except zlib.error as e:
            held, self.broken = self._salvage(), e
            if (cut := held.find(_END)) < 0:
                return None
        fields = _fields(held[:cut])
        return None if fields is None else (fields, held[cut + 4 :])

    def _salvage(self) -> bytes:
        """What decodes of a member whose first bytes hold an error: a small record's header may still be whole."""
        self.view.go(self.at)
        while self.view.end < self.fed and self.view.more():
            pass
        inflate, out = zlib.decompressobj(31), b""
        try:
            for k in range(self.at - self.view.start, self.fed - self.view.start):
                out += inflate.decompress(self.view.data[k : k + 1])
        except zlib.error:
            pass
        return out

    def rest(self, held: bytes) -> Iterator[bytes]:
        """All decoded bytes from ``held`` on; raises where the member is broken or cut off."""
        if held:
            yield held
        if self.broken is not None:
            raise self.broken
        while got := self._next(1 << 18):
            yield got
        if not self.inflate.eof:
            raise zlib.error("member cut off")

    @property
    def end(self) -> int:
        return self.fed - len(self.inflate.unused_data)


def _consume(fields: dict[str, str], pieces: Iterator[bytes], keep: bool) -> tuple[int | None, bytes | None, str]:
    """(payload bytes, the payload if kept, its digest in base32) of a record's block; an HTTP head is taken off first."""
    left = int(fields["content-length"])
    http = fields.get("content-type", "").startswith("application/http")
    head, length, seen, sha, kept = b"", None, 0, hashlib.sha1(), []
    for got in pieces:
        got = got[:left]
        left -= len(got)
        if http:
            head += got
            cut = head.find(_END)
            if cut < 0:
                continue
            found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", head[:cut])
            length = int(found[1]) if found else None
            got, http = head[cut + 4 :], False
        seen += len(got)
        sha.update(got)
        if keep:
            kept.append(got)
    if left:
        raise zlib.error("block cut off")
    if fields["warc-type"] == "revisit":  # the payload is elsewhere; its length is in the HTTP head
        return length, None, ""
    return seen, b"".join(kept) if keep else None, base64.b32encode(sha.digest()).decode()


RECORD = "path string, offset long, end long, record_type string, record_id string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, problem string"


def scan_range(src, size: int, lo: int, hi: int, *, piece: int = 1 << 20, keep: bool = False) -> Iterator[tuple]:
    """Records of an open file whose member starts in [lo, hi), as tuples from offset on in the order of RECORD.

    A candidate without a whole header is no member. A member with a header but
    with a broken rest is a record with a problem, and the scan goes on behind its magic.
    """
    view = _Window(src, lo, size, piece)
    at = lo
    while at < hi:
        view.go(at)
        found = _MAGIC.search(view.data, at - view.start)
        if found is None:
            # a magic may lie across the end of what is read
            at = max(at, view.end - 3)
            if not view.more():
                return
            continue
        start = view.start + found.start()
        if start >= hi:
            return
        one = _Member(view, start)
        told = one.header()
        if told is None:
            at = start + 1
            continue
        fields, held = told
        payload, problem = (None, None, ""), None
        try:
            payload = _consume(fields, one.rest(held), keep)
            at = one.end
        except zlib.error as e:
            problem, at = str(e)[:200], start + 1
        stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if problem is None and payload[2] and stated and stated != payload[2]:
            problem = "payload digest differs"
        row = (start, at, fields["warc-type"], fields["warc-record-id"], _page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), payload[0], payload[2] or stated, _page_of(fields.get("warc-refers-to")), problem)
        yield (*row, payload[1]) if keep else row


def read_warc(files: DataFrame, *, range_bytes: int = 16 << 20, with_payload: bool = False) -> DataFrame:
    """Records of the archives (path, length), in ranges of ``range_bytes``: one row each, in the columns of RECORD.

    payload_digest is computed from the payload of a response and taken from the
    header of a revisit, whose payload_bytes come from its HTTP head. A broken record is returned with its problem. With ``with_payload`` the
    payload follows (null for revisits). A member that lies uncompressed in
    another one's payload, as in an archive of archives, is taken for a record where a
    range begins inside the outer one: see ``drop_nested``.
    """
    spark = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.where("length > 0").select("path", "length", starts.alias("lo"))
    names = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * with_payload
    types = {"string": pa.string(), "long": pa.int64()}
    kinds = [types[c.split()[1]] for c in RECORD.split(", ")] + [pa.binary()] * with_payload

    def make():
        def f(batch: pa.RecordBatch):
            for path, size, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                held: list[tuple] = []
                with fs.open_input_file(name) as src:
                    for row in scan_range(src, size, lo, min(size, lo + range_bytes), keep=with_payload):
                        held.append((path, *row))
                        if len(held) >= 1000 or (with_payload and sum(len(r[-1] or b"") for r in held) > 8 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        return f

    dealt = ranges.repartition(parts(spark), "path", "lo")
    return map_batches(dealt, make, RECORD + ", payload binary" * with_payload)


def drop_nested(records: DataFrame, *, range_bytes: int = 16 << 20) -> DataFrame:
    """The records but those that lie inside another record of their file.

    Inside one range the reader steps from member to member; only what a range
    found before the end of a record from an earlier range can be nested. So one
    row for each range, its farthest end, decides. ``range_bytes`` are those of the reader.
    """
    from pyspark.sql import Window

    at = F.floor(F.col("offset") / range_bytes)
    reach = records.groupBy("path", at.alias("_range")).agg(F.max("end").alias("_end"))
    before = F.max("_end").over(Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    reach = reach.select("path", "_range", before.alias("_before"))
    return records.withColumn("_range", at).join(reach, ["path", "_range"]).where("_before is null or offset >= _before").select(*records.columns)


def page_records(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_warc(pages, path, least_bytes=least_bytes)
    if not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
