"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; its normaliser, white-space marker, piece
scores and byte fallback are rebuilt as a tokenizer of the tokenizers library,
which encodes batches with several threads. Models whose pieces end at spaces encode
each different chunk of text that a worker meets once; all others, unigram models
among them, encode whole texts. Whatever is encoded is also encoded by the
sentencepiece library and compared.
"""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import map_batches
from .tokenizing import ChunkIds, text_starts

MARK = "▁"
#: Fixed values of the format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message: ints, or bytes of fixed or given length."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class SpModel:
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool

    @classmethod
    def parse(cls, data: bytes) -> SpModel:
        pieces, kind, fallback, charsmap, prefix, squeeze = [], UNIGRAM, False, b"", True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                f = dict(_fields(value))
                kind, fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                charsmap, prefix, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        return cls(pieces, kind, fallback, charsmap, prefix, squeeze)

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that a BPE model joins, best score first; pairs of one piece by the ids of their parts."""
        index = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = []
        for piece, score, kind in self.pieces:
            if kind == NORMAL:
                halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in index and piece[k:] in index]
                found += [(-score, index[piece], index[a], index[b], a, b) for a, b in halves]
        return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[:4])]

    def splits_at_spaces(self) -> bool:
        """Whether chunks that start with white space can be encoded apart: no piece has a marker or line feed inside or after other characters."""
        plain = not self.charsmap and not self.squeeze and self.kind == BPE
        return plain and not any("\n" in p or MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind != BYTE)

    def tokenizer(self, *, prefix: bool = True):
        """The model as a tokenizer of the tokenizers library; ``prefix=False`` leaves the dummy prefix out."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == BPE:
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        steps = []
        if self.charsmap:
            steps.append(normalizers.Precompiled(self.charsmap))
        if self.squeeze:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        out = Tokenizer(model)
        out.normalizer = normalizers.Sequence(steps)
        ends = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix and prefix else []
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        return out


def space_cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks: each text, each run of spaces, each line feed and what follows it."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[1:n] = (buf[1:] == 0x20) & (buf[:-1] != 0x20) & (buf[:-1] != 0x81)  # 0x81 may end a literal marker
    feed = buf == 0x0A
    cut[1 : n + 1] |= feed
    cut[:n] |= feed
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class SpChunks(ChunkIds):
    """Ids of chunks; their marks tell if both libraries agree (1) and if decoding gives the chunk back (2).

    A chunk is a whole text (``whole``) if the model can't be cut at spaces.
    """

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.threads = threads
        super().__init__(path)
        self.cuts = text_starts if self.whole else space_cuts

    def load(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.model = SpModel.parse(data)
        self.whole = not self.model.splits_at_spaces()
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        return self.model.tokenizer(prefix=self.whole)

    def encode_chunks(self, chunks):
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        if self.whole:
            same = [a == b for a, b in zip(found, self.other.encode(chunks, num_threads=self.threads), strict=True)]
            back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
            return found, np.array([ok + 2 * (b == c) for ok, b, c in zip(same, back, chunks, strict=True)], np.uint8)
        # the library puts its dummy prefix before the chunk: given without its first space, it has it again
        lead = [c[:1] == " " for c in chunks]
        theirs = self.other.encode([c[1:] if x and len(c) > 1 else c for c, x in zip(chunks, lead, strict=True)], num_threads=self.threads)
        first = self.other.piece_to_id(MARK)
        same = [a == b if x else (b[:1] == [first] and a == b[1:]) for a, b, x in zip(found, theirs, lead, strict=True)]
        # a chunk without a leading space, or of spaces alone, is compared as it stands behind the prefix
        for i, (ok, c, x) in enumerate(zip(same, chunks, lead, strict=True)):
            if not ok and not (x and len(c) > 1):
                whole = self.tokenizer.encode(" " + c, add_special_tokens=False).ids
                same[i] = whole == self.other.encode(c)
        back = self.tokenizer.decode_batch(found, skip_special_tokens=False)
        return found, np.array([ok + 2 * (b == c) for ok, b, c in zip(same, back, chunks, strict=True)], np.uint8)


_KEPT: dict[tuple[str, int], SpChunks] = {}


def sp_encode(docs: DataFrame, model_file: str, *, threads: int | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text of (doc_id, text).

    Returns doc_id, n_ids, n_byte_ids (ids of byte fallback), ids_crc32 (of the
    ids as little-endian 32-bit integers), parity (both libraries agree on all
    chunks), round_trip (decoding gives the text back), and with ``with_ids``
    the ids. A null or empty text has no ids, parity and a round trip; rows that
    repeat are encoded as often, other columns are ignored. Batches are encoded
    by ``threads`` threads: the session's spark.task.cpus, two at least.
    """
    threads = threads or max(2, int(docs.sparkSession.conf.get("spark.task.cpus", "1")))

    def make():
        if (model_file, threads) not in _KEPT:
            _KEPT[model_file, threads] = SpChunks(model_file, threads)
        table = _KEPT[model_file, threads]

        def f(batch: pa.RecordBatch):
            for lo, hi, buf, offsets in spans.slices(batch.column(1), 1 << 20):
                size = np.diff(offsets)
                if table.model.dummy_prefix and not table.whole:
                    buf = np.insert(buf, offsets[:-1][size > 0], np.uint8(0x20))
                    offsets = np.concatenate([[0], np.cumsum(size + (size > 0))])
                ids, n, _, _ = table.encode(buf, offsets)
                marks = table.marks[table.rows]
                good = [np.concatenate([[0], np.cumsum(marks & bit == 0)])[table.per_text] for bit in (1, 2)]
                ends = np.cumsum(n)
                small = ids.astype("<u4")
                raw = memoryview(small.tobytes())
                crc = [zlib.crc32(raw[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                fallback = np.concatenate([[0], np.cumsum(table.bytes[small])])
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(fallback[ends] - fallback[ends - n]), pa.array(crc, pa.int64())]
                cols += [pa.array(np.diff(g) == 0) for g in good]
                names = ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "parity", "round_trip"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(small.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names + ["ids"] * with_ids)

        return f

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids)


def sp_decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), by the rebuilt tokenizer; null ids give a null text."""

    def make():
        with open(model_file, "rb") as f:
            tokenizer = SpModel.parse(f.read()).tokenizer()

        def f(batch: pa.RecordBatch):
            ids = batch.column(1).to_pylist()
            texts = iter(tokenizer.decode_batch([x for x in ids if x is not None], skip_special_tokens=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else next(texts) for x in ids], pa.string())], ["doc_id", "text"])

        return f

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, text string")
