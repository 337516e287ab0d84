"""Token ids in binary shard files of patched frame-of-reference blocks.

A shard file holds, after a header, blocks of 1024 ids. Of each block the
minimum is subtracted; the rest is packed at a width that a given percentile of
its values fits into; what is wider goes to an exception list of (position,
value). A footer indexes the byte where each block starts, and the documents.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import arrow_map, fresh_dir, map_batches, parts, settle
from .tokenizing import chunk_ids

BLOCK, LANES = 1024, 64
MAGIC = b"FLPFOR2\0"
_HEAD = struct.Struct("<8sQQQQ")  # magic, ids, documents, blocks, byte where the footer starts
_BLOCK_HEAD = np.dtype([("base", "<u4"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2")])
_DOC = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("length", "<u8"), ("has_id", "u1")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) numbers to (blocks, 16 * width) words; 64 neighbours fill ``width`` words."""
    v = values.reshape(len(values), BLOCK // LANES, LANES)
    out = np.zeros((len(values), BLOCK // LANES, width), np.uint64)
    for k in range(LANES):
        word, shift = divmod(k * width, 64)
        out[:, :, word] |= v[:, :, k] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= v[:, :, k] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), BLOCK // LANES, width)
    out = np.zeros((len(words), BLOCK // LANES, LANES), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for k in range(LANES):
        word, shift = divmod(k * width, 64)
        x = w[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x |= w[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, k] = x & mask
    return out.reshape(len(words), BLOCK)


def encode_shard(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, percentile: float = 90.0, has_id: np.ndarray | None = None) -> bytes:
    """The bytes of one shard file; ``has_id`` is false for documents whose doc_id is null."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    v = padded.reshape(n_blocks, BLOCK)
    base = v.min(axis=1) if n_blocks else np.zeros(0, np.uint64)
    v = v - base[:, None]
    cut = np.partition(v, int(BLOCK * percentile / 100), axis=1)[:, int(BLOCK * percentile / 100)] if n_blocks else base
    width = np.maximum(1, np.ceil(np.log2(cut.astype(np.float64) + 1))).astype(np.int64)
    wide = v >> width[:, None].astype(np.uint64) != 0
    n_wide = wide.sum(axis=1)
    sizes = _BLOCK_HEAD.itemsize + width * (BLOCK // 8) + n_wide * 6
    starts = _HEAD.size + np.cumsum(sizes) - sizes
    end = _HEAD.size + int(sizes.sum())
    out = np.zeros(end, np.uint8)
    heads = np.zeros(n_blocks, _BLOCK_HEAD)
    heads["base"], heads["width"], heads["exceptions"] = base, width, n_wide
    low = v & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))[:, None]
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(low[rows], int(w)).view(np.uint8).reshape(len(rows), -1)
        for r, bits in zip(rows.tolist(), packed, strict=True):
            at = int(starts[r])
            out[at : at + 8] = heads[r : r + 1].view(np.uint8)
            out[at + 8 : at + 8 + len(bits)] = bits
            if n_wide[r]:
                where = np.flatnonzero(wide[r])
                tail = np.concatenate([where.astype("<u2").view(np.uint8), v[r, where].astype("<u4").view(np.uint8)])
                out[at + 8 + len(bits) : at + 8 + len(bits) + len(tail)] = tail
    docs = np.zeros(len(doc_ids), _DOC)
    docs["doc_id"], docs["length"], docs["has_id"] = doc_ids, lengths, True if has_id is None else has_id
    docs["start"] = np.cumsum(lengths) - lengths
    head = _HEAD.pack(MAGIC, len(ids), len(doc_ids), n_blocks, end)
    out[: _HEAD.size] = np.frombuffer(head, np.uint8)
    return out.tobytes() + starts.astype("<u8").tobytes() + docs.tobytes()


def read_index(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of ids, byte where each block starts, documents) of a shard file."""
    magic, n, n_docs, n_blocks, foot = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    return n, np.frombuffer(data, "<u8", n_blocks, foot), np.frombuffer(data, _DOC, n_docs, foot + 8 * n_blocks)


def decode_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` of a shard file; only the blocks that hold them are decoded."""
    n, starts, _ = read_index(data)
    last = n if last is None else last
    if last <= first:
        return np.zeros(0, np.uint32)
    lo, hi = first // BLOCK, -(-last // BLOCK)
    at = starts[lo:hi].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[at[:, None] + np.arange(8)].copy().view(_BLOCK_HEAD).reshape(-1)
    out = np.zeros((hi - lo, BLOCK), np.uint64)
    for w in np.unique(heads["width"]):
        rows = np.flatnonzero(heads["width"] == w)
        bits = raw[at[rows][:, None] + 8 + np.arange(int(w) * BLOCK // 8)].copy().view(np.uint64)
        out[rows] = _unpack(bits, int(w))
    for r in np.flatnonzero(heads["exceptions"]):
        k = int(heads["exceptions"][r])
        tail = int(at[r]) + 8 + int(heads["width"][r]) * BLOCK // 8
        where = np.frombuffer(data, "<u2", k, tail)
        out[r, where] = np.frombuffer(data, "<u4", k, tail + 2 * k)
    out += heads["base"].astype(np.uint64)[:, None]
    return out.reshape(-1)[first - lo * BLOCK : last - lo * BLOCK].astype(np.uint32)


def ordered_docs(docs: DataFrame, *, range_bytes: int = 8 << 20, most_ranges: int = 10_000) -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id, in order inside each; without ids first, equal ids by the text's hash.

    The number of ranges follows from the bytes of text, never from the
    session: about ``range_bytes`` each, or more where that makes more than
    ``most_ranges``. Rows of one doc_id are dealt by hash and, where all is equal, by place.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    ranges = max(1, min(-(-total // range_bytes), most_ranges))
    docs = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"), "text")
    return docs.repartitionByRange(ranges, "doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, percentile: float = 90.0, shard_ids: int = 4_000_000, range_bytes: int = 8 << 20) -> DataFrame:
    """Encode (doc_id, text) and write shard files below ``path``, in ascending order of doc_id.

    Runs at once. Returns the manifest, one row per shard: (task, part, path,
    n_docs, n_tokens, first_token), from a table beside the files; first_token is summed by task and then
    inside each task. Each task writes its range of documents in
    files of about ``shard_ids`` ids, first under a name of its own, then
    renamed: an attempt that is lost or runs twice leaves the same files. A null
    text counts as empty; a document without text holds the end id alone.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        table = chunk_ids(tokenizer)
        held: list[tuple[np.ndarray, ...]] = []
        part = 0

        def flush():
            doc_ids, has_id, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{root}/shard-{task:06d}-{part:06d}"
            with fs.open_output_stream(f"{name}.{attempt}.tmp") as f:
                f.write(encode_shard(doc_ids, lengths, ids, percentile, has_id))
            fs.move(f"{name}.{attempt}.tmp", f"{name}.bin")
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "part": pa.array([part], pa.int64()), "path": [f"{path}/shard-{task:06d}-{part:06d}.bin"], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_tokens": pa.array([len(ids)], pa.int64())})

        for batch in batches:
            doc_id, has_id = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, buf, offsets in spans.slices(batch.column(1)):
                ids, lengths, _, _ = table.encode(buf, offsets)
                with_end = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
                held.append((doc_id[lo:hi], has_id[lo:hi], lengths + 1, with_end))
                if sum(len(x[3]) for x in held) >= shard_ids:
                    yield flush()
                    held, part = [], part + 1
        if held:
            yield flush()

    manifest = settle(arrow_map(ordered_docs(docs, range_bytes=range_bytes), write, "task long, part long, path string, n_docs long, n_tokens long"), "manifest")
    tasks = manifest.groupBy("task").agg(F.sum("n_tokens").alias("n"))  # one row per task, ``most_ranges`` at most
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("task").orderBy("part")) - F.col("n_tokens")
    return manifest.join(tasks, "task").select("task", "part", "path", "n_docs", "n_tokens", (F.col("before") + inside).alias("first_token"))


def read_tokens(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Read shard files back: one row per document.

    Returns doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with ``with_ids`` the ids themselves. A doc_id that was null
    comes back null.
    """

    def make():
        def f(batch: pa.RecordBatch):
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(name) as src:
                    data = src.read()
                _, _, docs = read_index(data)
                ids = decode_ids(data).astype("<u4")
                raw = memoryview(ids.tobytes())
                start, length = docs["start"].astype(np.int64), docs["length"].astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), length.tolist(), strict=True)]
                doc_id = docs["doc_id"]
                cols = [pa.array(doc_id, mask=docs["has_id"] == 0), pa.array(base + start), pa.array(length), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                for lo in range(0, len(docs), 2000):  # batches of bounded size
                    part = [c.slice(lo, 2000) for c in cols]
                    if with_ids:
                        a, b = start[lo], start[min(lo + 2000, len(docs)) - 1] + length[min(lo + 2000, len(docs)) - 1]
                        part.append(pa.ListArray.from_arrays(pa.array(np.append(start[lo : lo + 2000], b) - a, pa.int32()), pa.array(ids[a:b].astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(part, names + ["ids"] * with_ids)

        return f

    spark = manifest.sparkSession
    dealt = manifest.select("path", "first_token").repartition(parts(spark), "path")
    return map_batches(dealt, make, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """Write the documents' ids to new files in the shared folder and read them back."""
    path = fresh_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, tokenizer, end_id=end_id))
