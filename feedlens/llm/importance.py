"""Importance resampling of documents toward a target distribution.

Every document's runs of one and two words are counted in buckets of their hash.
The document-by-bucket matrix is written once, as blocks of sparse rows. Its
column sums are the corpus' distribution, those of the target texts' matrix the
target's; the product of the matrix with the buckets' gains gives each document's
weight, and the highest weights with Gumbel noise are a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spans
from .common import arrow_map, forget, map_batches, settle

#: A word's bytes: digits, letters in lower case, and all bytes of characters beyond ASCII.
_INK = np.zeros(256, bool)
_INK[0x30:0x3A] = _INK[0x61:0x7B] = _INK[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass(frozen=True)
class DrawRules:
    """Runs of 1 to ``longest`` words; ``percent`` of the documents with ``least_words`` or more are drawn."""

    buckets: int = 10_000
    longest: int = 2
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def _crc_table() -> np.ndarray:
    """What the reflected polynomial of CRC-32 makes of each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()
_FULL = np.uint32(0xFFFFFFFF)


def crc_on(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, longest: int = 48) -> np.ndarray:
    """CRC-32 registers after the bytes of each span, from the registers before; spans beyond ``longest`` bytes one by one."""
    out, length = state.copy(), ends - starts
    for i in np.flatnonzero(length > longest).tolist():
        out[i] = zlib.crc32(buf[starts[i] : ends[i]].tobytes(), int(state[i] ^ _FULL)) ^ 0xFFFFFFFF
    who = np.flatnonzero((length > 0) & (length <= longest))
    at, stop, reg = starts[who], ends[who], state[who]
    while len(who):
        reg = (reg >> np.uint32(8)) ^ _CRC[(reg & np.uint32(255)).astype(np.uint8) ^ buf[at]]
        at = at + 1
        done = at == stop
        if done.any():
            out[who[done]] = reg[done]
            left = ~done
            who, at, stop, reg = who[left], at[left], stop[left], reg[left]
    return out


def feature_buckets(buf: np.ndarray, offsets: np.ndarray, rules: DrawRules = DrawRules()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature of every text, and the words of each text.

    The hash of a longer run goes on from that of its first words, so each run costs its last word.
    """
    lowered = _LOWER[buf]
    clean = np.where(_INK[lowered], lowered, np.uint8(32))
    starts, ends, counts = spans.words(clean, offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(np.cumsum(counts), counts)
    reg = crc_on(np.full(len(starts), _FULL), clean, starts, ends)
    found, who = [reg ^ _FULL], [text]
    first = np.arange(len(starts))
    for k in range(1, rules.longest):
        inside = first + k < last[first]
        first, reg = first[inside], reg[inside]
        reg = (reg >> np.uint32(8)) ^ _CRC[(reg & np.uint32(255)).astype(np.uint8) ^ np.uint8(32)]
        reg = crc_on(reg, clean, starts[first + k], ends[first + k])
        found.append(reg ^ _FULL)
        who.append(text[first])
    return np.concatenate(who), np.concatenate(found).astype(np.int64) % rules.buckets, counts


BLOCK = "doc_id array<long>, n_words array<long>, indptr binary, bucket binary, amount binary"


def count_matrix(docs: DataFrame, rules: DrawRules = DrawRules(), *, block_bytes: int = 1 << 20) -> DataFrame:
    """The document-by-bucket counts of (doc_id, text), one row for each block of documents of about ``block_bytes`` of text.

    A block holds its documents' ids and numbers of words, and their sparse
    rows: where each row starts (64-bit), buckets (16-bit, ascending in a row)
    and counts (32-bit). A null text counts as empty and has an empty row.
    """
    if rules.buckets > 1 << 16:
        raise ValueError("buckets are stored in 16 bits")

    def make():
        def f(batch: pa.RecordBatch):
            for lo, hi, buf, offsets in spans.slices(batch.column(1), block_bytes):
                text, bucket, words = feature_buckets(buf, offsets, rules)
                cell, amount = np.unique(text * rules.buckets + bucket, return_counts=True)
                row, column = np.divmod(cell, rules.buckets)
                indptr = np.searchsorted(row, np.arange(hi - lo + 1))
                raw = [indptr.astype("<i8").tobytes(), column.astype("<u2").tobytes(), amount.astype("<u4").tobytes()]
                ids = batch.column(0).slice(lo, hi - lo)
                lists = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x) for x in (pa.concat_arrays([ids]), pa.array(words))]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in raw)], ["doc_id", "n_words", "indptr", "bucket", "amount"])

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, BLOCK)


def _blocks(batch: pa.RecordBatch):
    """(ids, words, indptr, buckets, counts) of each block of a batch."""
    for i in range(batch.num_rows):
        raw = [np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((2, "<i8"), (3, "<u2"), (4, "<u4"))]
        yield batch.column(0)[i].values, batch.column(1)[i].values.to_numpy(zero_copy_only=False), *raw


def column_sums(matrix: DataFrame, rules: DrawRules = DrawRules()) -> tuple[np.ndarray, int, int]:
    """(features in each bucket, documents with enough words, all documents) of a stored matrix.

    Each task sums its blocks; ``rules.buckets`` numbers and two more reach the driver, whatever the corpus' size.
    """

    def sums(batches):
        total = np.zeros(rules.buckets + 2, np.int64)
        for batch in batches:
            for _, words, _, bucket, amount in _blocks(batch):
                total[:-2] += np.bincount(bucket, weights=amount, minlength=rules.buckets).astype(np.int64)
                total[-2:] += (words >= rules.least_words).sum(), len(words)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = arrow_map(matrix, sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(rules.buckets + 2, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out[:-2], int(out[-2]), int(out[-1])


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of how much likelier a bucket is in the target, each count raised by one; rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, by the SHA-256 of seed and id; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(matrix: DataFrame, gains: np.ndarray, rules: DrawRules = DrawRules()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document of a stored matrix.

    The weight is the mean gain of its features, rounded down, 0 without features; the score adds the noise.
    """

    def make():
        def f(batch: pa.RecordBatch):
            for ids, words, indptr, bucket, amount in _blocks(batch):
                before = np.zeros((2, len(bucket) + 1), np.int64)
                np.cumsum(amount, out=before[0, 1:])
                np.cumsum(gains[bucket] * amount, out=before[1, 1:])
                n, gained = before[:, indptr[1:]] - before[:, indptr[:-1]]
                weight = gained // np.maximum(n, 1)
                score = weight + np.array([noise(i, rules.seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

        return f

    return map_batches(matrix, make, "doc_id long, n_words long, n_features long, weight long, score long")


def rank_drawn(scored: DataFrame, drawn: int, rows: int, rules: DrawRules = DrawRules(), *, range_rows: int = 500_000, most_ranges: int = 10_000) -> DataFrame:
    """Adds rank: 1 to ``drawn`` in the order of score and, among equals, of smaller doc_id; null for the rest.

    The rows are dealt by ranges of that order and sorted inside each, so the
    place in the whole order is the place in the range and the rows of the ranges
    before: no task holds more than its range, whatever repeats.
    """
    ranges = max(1, min(-(-rows // range_rows), most_ranges))
    order = [F.col("n_words") < rules.least_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "place"]
    dealt = scored.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = settle(dealt.drop("place").withColumn("place", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumns({"range": F.shiftright("place", 33), "inside": F.col("place").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # ``most_ranges`` rows at most
    sizes = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("inside") + 1
    good = (F.col("n_words") >= rules.least_words) & (rank <= drawn)
    return placed.join(F.broadcast(sizes), "range").withColumn("rank", F.when(good, rank)).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, rules: DrawRules = DrawRules()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text), drawn toward ``target`` (text).

    Null and empty texts have no features, weight 0, and aren't drawn. Rows that
    repeat an id are documents of their own with the same noise; a null id stands
    behind all others of its score. An empty target makes all its buckets alike. Extra columns are ignored.
    """
    matrix = settle(count_matrix(docs, rules), "matrix")
    aim = count_matrix(target.select(F.lit(0).cast("long").alias("doc_id"), "text"), rules)
    corpus, enough, rows = column_sums(matrix, rules)
    scored = settle(weigh(matrix, bucket_gains(corpus, column_sums(aim, rules)[0]), rules), "scored")
    forget(matrix)
    return rank_drawn(scored, rules.percent * enough // 100, rows, rules)
