"""Alignment of two tokenizers' tokens over whole texts, by different segments of text.

Texts are split before runs of white space, where the vocabularies of both
tokenizers are checked to hold nothing that could join across. Blocks of
documents keep their segments by number. The blocks' different segments meet by
their text, where each is tokenised and aligned once, and its alignment goes back to
every block that has it; a block composes its documents from them. How many
documents link two ids is summed from the blocks' own counts and joined back once more.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import arrow_map, forget, settle
from .spm import BPE, BYTE, MARK, SpModel
from .tokenizing import cutting_of

_ASCII_WHITE = {chr(c) for c in (*range(0x09, 0x0E), 0x20)}


def _codes(points) -> np.ndarray:
    return np.array(sorted(int.from_bytes(chr(c).encode(), "big") for c in points), np.int64)


_WIDE2 = [0x85, 0xA0]
_WIDE3 = [0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_WIDE_WHITE = {chr(c) for c in (*_WIDE2, *_WIDE3)}
#: White space beyond ASCII, by the length of its UTF-8; a few characters that some patterns count as such among it.
_WHITE2, _WHITE3 = _codes(_WIDE2), _codes(_WIDE3)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level entries: visible ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass
class TokenBytes:
    """The bytes of each id of both tokenizers, and the white space that a run must begin with for texts to be split before it."""

    a: list[bytes]
    b: list[bytes]
    splits: str

    @classmethod
    def load(cls, path_a: str, path_b: str) -> TokenBytes:
        with open(path_a, encoding="utf-8") as f:
            definition = json.load(f)
        with open(path_b, "rb") as f:
            model = SpModel.parse(f.read())
        alphabet = byte_alphabet()
        vocab = definition["model"]["vocab"]
        added = {t["content"] for t in definition.get("added_tokens", [])}
        a = [b""] * (max(max(vocab.values()), max((t["id"] for t in definition.get("added_tokens", [])), default=0)) + 1)
        for entry, i in vocab.items():
            a[i] = entry.encode() if entry in added else bytes(alphabet[c] for c in entry)
        b = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        entries = [a[i].decode("utf-8", "replace") for entry, i in vocab.items() if entry not in added]
        entries += [p.replace(MARK, " ") for p, _, kind in model.pieces if kind != BYTE]
        # the one must split texts into pre-tokens, of which white space begins one; the other must join by pieces alone
        known = cutting_of(definition) == "bytes" and model.kind == BPE and model.dummy_prefix and not model.charsmap and not model.squeeze
        return cls(a, b, "".join(sorted(_ASCII_WHITE - joining(entries))) if known else "")


def joining(entries) -> set[str]:
    """ASCII white space that stands after a character other than white space in some entry, which so could reach across a cut."""
    return {c for e in entries for p, c in zip(e, e[1:]) if c in _ASCII_WHITE and not (p in _ASCII_WHITE or p in _WIDE_WHITE)}


def run_cuts(buf: np.ndarray, offsets: np.ndarray, splits: str) -> np.ndarray:
    """Sorted starts of segments: each non-empty text, and inside one each run of white space that begins with a character of ``splits``."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    white = spans.SPACE[buf] | ((buf >= 0x1C) & (buf <= 0x1F))
    begins = np.isin(np.arange(256), list(splits.encode()))
    at = np.flatnonzero(begins[buf][1:] & ~white[:-1]) + 1 if n else np.zeros(0, np.int64)
    byte = lambda k: np.where(at >= k, buf[np.maximum(at - k, 0)], 0).astype(np.int64)
    two = byte(2) << 8 | byte(1)
    cut[at[~(np.isin(two, _WHITE2) | np.isin(byte(3) << 16 | two, _WHITE3))]] = True
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _squeezed(values: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _whole(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(table.column(name)[0].as_buffer()), kind)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that start at ``starts``, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _bytes_list(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of numbers, which end at ``ends``, as binary values."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


BLOCK = "block long, doc_id array<long>, ends binary, place binary, segments array<string>"


def segment_blocks(docs: DataFrame, splits: str, *, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, text) as blocks of documents of about ``block_bytes``: ids, the segments' numbers of each document, and the block's different segments, most frequent first.

    A text stands with a space before it; null and empty texts have no segment.
    """

    def run(batches):
        block, held, size = TaskContext.get().partitionId() << 33, [], 0

        def emit():
            nonlocal block
            rows = pa.Table.from_batches(held).combine_chunks()
            for lo, hi, buf, offsets in spans.slices(rows.column(1), block_bytes):
                length = np.diff(offsets)
                buf = np.insert(buf, offsets[:-1][length > 0], np.uint8(0x20))
                offsets = np.concatenate([[0], np.cumsum(length + (length > 0))])
                starts = run_cuts(buf, offsets, splits) if splits else offsets[:-1][length > 0]
                ends = np.append(starts[1:], len(buf)) if len(starts) else starts
                _, first, place, often = np.unique(spans.hash_spans(buf, starts, ends), return_index=True, return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                first = first[order]
                sizes = (ends - starts)[first]
                text = _bytes_list(buf[_ragged(starts[first], sizes)], np.cumsum(sizes)).cast(pa.string())
                ids = rows.column(0).slice(lo, hi - lo).combine_chunks()
                one = lambda x: pa.array([x], pa.binary())
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, text)]
                yield pa.RecordBatch.from_arrays([pa.array([block]), lists[0], one(_squeezed(np.searchsorted(starts, offsets), "<i8")), one(_squeezed(rank[place], "<u4")), lists[1]], [c.split()[0] for c in BLOCK.split(", ")])
                block += 1

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= block_bytes:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, BLOCK)


#: Steps along two rows of tokens: from a link to the next one a token of both ends, of the first alone, or of the second;
#: of both at the segment's end. A segment without tokens has a mark in their place.
BOTH, FIRST, SECOND, LAST, NONE = range(5)


class SegmentTokens:
    """Encodes segments with both libraries and aligns them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        of = TokenBytes.load(path_a, path_b)
        self.of_a, self.of_b = of.a, of.b
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (of.a, of.b))
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.mark = self.b.piece_to_id(MARK)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both. The second library puts a space before whatever it gets: a segment's own first space, or one to take off again."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[:1] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":  # nothing is left of it
                b[i] = [self.mark]
            elif s[:1] != " ":
                if b[i][:1] != [self.mark]:
                    raise ValueError("the space before a segment joined it")
                b[i] = b[i][1:]
        return a, b

    def align(self, segments: list[str], a: list[list[int]], b: list[list[int]]):
        """(ids of both in a row, steps in a row, ids of the first, of the second and steps of each segment).

        A segment whose bytes either tokenizer doesn't give back has no ids and one
        step, NONE. All others' tokens cover the same bytes, so they are aligned in a row:
        between two ends of any tokens lies one link.
        """
        raw = [s.encode() for s in segments]
        text = lambda ids, of: b"".join([of[i] for x in ids for i in x])
        if not text(a, self.of_a) == text(b, self.of_b) == b"".join(raw):
            good = [b"".join([self.of_a[i] for i in x]) == r == b"".join([self.of_b[i] for i in y]) for r, x, y in zip(raw, a, b, strict=True)]
            a, b, raw = ([x if ok else x[:0] for x, ok in zip(t, good, strict=True)] for t in (a, b, raw))
        n_a, n_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
        flat = [np.fromiter((i for x in t for i in x), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b))]
        ends = [np.cumsum(length[x]) for length, x in zip((self.length_a, self.length_b), flat, strict=True)]
        every = np.union1d(*ends)
        within = [np.isin(every, e, assume_unique=True) for e in ends]
        steps = np.where(within[0], np.where(within[1], BOTH, FIRST), SECOND).astype(np.uint8)
        stop = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        last = np.searchsorted(every, stop, side="right")
        none = np.diff(last, prepend=0) == 0
        steps[last[~none] - 1] = LAST
        steps = np.insert(steps, last[none], NONE)
        return *flat, steps, n_a, n_b, np.diff(last, prepend=0) + none


def _kinds(wide: bool) -> tuple[str, str, str]:
    """How ids of both and steps are stored."""
    return ("<u4", "<u4", "u1") if wide else ("<u2", "<u2", "u1")


_KEPT: dict[tuple[str, str], SegmentTokens] = {}
ALIGNED = "of long, packed boolean, place binary, a binary, b binary, steps binary"


def align_segments(segments: DataFrame, path_a: str, path_b: str, *, wide: bool = False, run_rows: int = 100_000, pack_rows: int = 32) -> DataFrame:
    """The alignments of (block, place, segment), some of a block in each row, in the columns of ALIGNED.

    Equal segments meet in one task, sorted, and are encoded once: of each there
    is one in a block, so a frequent one has as many rows as there are blocks, which pass by in
    runs of ``run_rows``. A row holds places (each but the first less the one before), ids (16 bits, or 32 if ``wide``) and steps; it is compressed
    where a run has ``pack_rows`` segments for each of its blocks.
    """

    def run(batches):
        if (path_a, path_b) not in _KEPT:
            _KEPT[path_a, path_b] = SegmentTokens(path_a, path_b)
        tokens = _KEPT[path_a, path_b]
        held, size = [], 0
        last: tuple[str, list[int], list[int]] | None = None

        def emit():
            nonlocal last
            rows = pa.Table.from_batches(held).combine_chunks()
            texts = rows.column(2).chunk(0).dictionary_encode()
            words, which = texts.dictionary.to_pylist(), texts.indices.to_numpy()
            known = last is not None and words[0] == last[0]
            a, b = tokens.encode(words[1:] if known else words)
            if known:
                a, b = [last[1], *a], [last[2], *b]
            last = words[-1], a[-1], b[-1]
            flat_a, flat_b, steps, *sizes = tokens.align(words, a, b)
            block, place = rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)
            order = np.lexsort((place, block))
            block, place, which = block[order], place[order], which[order]
            chunk = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
            gap = np.diff(place, prepend=0)
            gap[chunk[:-1]] = place[chunk[:-1]]
            columns = [_bytes_list(gap.astype("<u4"), chunk)]
            for flat, n, kind in zip((flat_a, flat_b, steps), sizes, _kinds(wide), strict=True):
                own = n[which]
                columns.append(_bytes_list(flat[_ragged((np.cumsum(n) - n)[which], own)].astype(kind), np.cumsum(own)[chunk - 1]))
            packed = len(block) >= pack_rows * len(chunk)
            if packed:
                pack = zstandard.ZstdCompressor(level=1).compress
                columns = [pa.array([pack(v.as_buffer()) for v in c], pa.binary()) for c in columns]
            columns = [pa.array(block[chunk - 1]), pa.array(np.full(len(chunk), packed)), *columns]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= run_rows:
                    yield from emit()
                    held, size = [], 0
        if held:
            yield from emit()

    dealt = segments.select("block", "place", "segment").repartition("segment").sortWithinPartitions("segment")
    return arrow_map(dealt, run, ALIGNED)


def _rendered(ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Decimal numbers, each with the mark behind it, in a row, and where each ends."""
    powers = 10 ** np.arange(10, dtype=np.int64)
    digits = np.maximum(np.searchsorted(powers, ids, side="right"), 1)
    width = int(digits.max(initial=1)) + 1
    out = np.zeros((len(ids), width), np.uint8)
    at = np.arange(width)
    for k in range(width - 1):
        out[:, k] = 0x30 + ids // powers[np.maximum(digits - 1 - k, 0)] % 10
    out[np.arange(len(ids)), digits] = marks
    return out[at <= digits[:, None]].tobytes(), np.cumsum(digits + 1)


def group_texts(a: np.ndarray, b: np.ndarray, steps: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
    """Each segment's groups as a1,a2|b1;a3|b2,b3."""
    moves_a, moves_b = _moves(steps)
    end = moves_a & moves_b
    group = np.cumsum(end) - end  # of each step
    n_groups = int(end.sum())
    in_a, in_b = np.bincount(group[moves_a], minlength=n_groups), np.bincount(group[moves_b], minlength=n_groups)
    first = np.cumsum(in_a + in_b) - in_a - in_b
    ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[_ragged(first, in_a)], ids[_ragged(first + in_a, in_b)] = a, b
    marks[first + in_a - 1], marks[first + in_a + in_b - 1] = ord("|"), ord(";")
    text, ends = _rendered(ids, marks)
    stop = np.concatenate([[0], ends])[np.cumsum(n_a + n_b)]
    start = np.concatenate([[0], stop[:-1]])
    return [text[x : y - 1] if y > x else b"" for x, y in zip(start.tolist(), stop.tolist(), strict=True)]


def _moves(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a token of the first, of the second ends with each step."""
    both = (steps == BOTH) | (steps == LAST)
    return both | (steps == FIRST), both | (steps == SECOND)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
COMPOSED = "block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in _COUNTS) + ", digest array<string>, cells binary, amount binary, pairs array<long>, n_docs array<long>"


def _sums(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of the rows of a sparse matrix."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[indptr[1:]] - total[indptr[:-1]]


def _list_of(values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _segments_of(aligned: pa.Table, wide: bool):
    """(ids of both, steps, each segment's number of these) of a block's segments in their order."""
    unpack = zstandard.ZstdDecompressor().decompress
    packed = aligned.column("packed").to_pylist()
    chunks = lambda c, kind: [np.frombuffer(unpack(v) if p else v, kind) for v, p in zip(aligned.column(c).to_pylist(), packed, strict=True)]
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    order = np.argsort(joined([np.cumsum(x, dtype=np.int64) for x in chunks("place", "<u4")], np.int64))
    flat = [joined(chunks(c, k), k) for c, k in zip(("a", "b", "steps"), _kinds(wide), strict=True)]
    steps = flat[2]
    stop = np.flatnonzero(steps >= LAST) + 1
    n_steps = np.diff(stop, prepend=0)
    totals = [np.concatenate([[0], np.cumsum(m)])[stop] for m in _moves(steps)]
    sizes = [*(np.diff(t, prepend=0) for t in totals), n_steps]
    return [x[_ragged((np.cumsum(n) - n)[order], n[order])] for x, n in zip(flat, sizes, strict=True)], [n[order] for n in sizes]


def _composer(wide: bool, at_once: int = 100_000):
    def compose(block: pa.Table, aligned: pa.Table) -> pa.Table:
        """One block's documents from its segments' alignments, with the block's linked pairs: a sparse document-by-pair matrix and the documents of each pair.

        Links are counted for some documents at a time, of about ``at_once`` segments.
        """
        indptr, place = _whole(block, "ends", "<i8"), _whole(block, "place", "<u4")
        (a, b, steps), (n_a, n_b, n_steps) = _segments_of(aligned, wide)
        moves_a, moves_b = _moves(steps)
        step_ends = np.concatenate([[0], np.cumsum(n_steps)])
        per_segment = [n_a, n_b, _sums(moves_a & moves_b, step_ends), np.where(n_a > 0, n_steps, 0)]
        n_docs, n_segments = len(indptr) - 1, max(len(n_a), 1)
        whole = (_sums(n_a[place] == 0, indptr) == 0) & (np.diff(indptr) > 0)
        columns = [np.where(whole, _sums(n[place], indptr), 0) for n in per_segment]
        texts = group_texts(a, b, steps, n_a, n_b)
        digest = [hashlib.sha256(b";".join(map(texts.__getitem__, place[x:y].tolist()))).hexdigest() if ok else "" for ok, x, y in zip(whole.tolist(), indptr.tolist(), indptr[1:].tolist())]
        del texts
        # every step's id pair, of the block's segments in a row; a document with a segment without tokens has no links
        pad = lambda x: np.append(x, x[:0].dtype.type(0)).astype(np.int64)
        link = pad(a)[np.cumsum(moves_a) - moves_a] << 32 | pad(b)[np.cumsum(moves_b) - moves_b]
        pairs, of_link = np.unique(link, return_inverse=True)
        n_pairs = max(len(pairs), 1)
        cells, amounts, lo = [], [], 0
        while lo < n_docs:
            hi = max(lo + 1, int(np.searchsorted(indptr, indptr[lo] + at_once, side="right")) - 1)
            doc = np.repeat(np.arange(lo, hi), np.diff(indptr[lo : hi + 1]))
            mine = whole[doc]
            cell, often = np.unique(doc[mine] * n_segments + place[indptr[lo] : indptr[hi]][mine], return_counts=True)
            doc, segment = np.divmod(cell, n_segments)
            size = n_steps[segment]
            cell, back = np.unique(np.repeat(doc, size) * n_pairs + of_link[_ragged(step_ends[segment], size)], return_inverse=True)
            cells.append(cell)
            amounts.append(np.bincount(back, weights=np.repeat(often, size), minlength=len(cell)).astype(np.uint32))
            lo = hi
        cell = np.concatenate(cells) if cells else np.zeros(0, np.int64)
        holding = np.bincount(cell % n_pairs, minlength=n_pairs)[: len(pairs)]
        rank = np.argsort(-holding, kind="stable")  # frequent pairs get small numbers, which are written in fewer bytes
        number = np.empty(n_pairs, np.int64)
        number[rank] = np.arange(len(rank))
        used = int((holding > 0).sum())
        cell = cell // n_pairs * max(used, 1) + number[cell % n_pairs]
        order = np.argsort(cell)
        one = lambda x: pa.array([x], pa.binary())
        return pa.Table.from_arrays([
            block.column("block"), _list_of(block.column("doc_id").chunk(0).flatten()), *map(_list_of, columns), _list_of(pa.array(digest, pa.string())),
            one(_squeezed(np.diff(cell[order], prepend=0), "<i8")), one(_squeezed((np.concatenate(amounts) if amounts else cell)[order], "<u4")), _list_of(pairs[rank[:used]]), _list_of(holding[rank[:used]]),
        ], [c.split()[0] for c in COMPOSED.split(", ")])

    return compose


def pair_counts(composed: DataFrame) -> DataFrame:
    """(pair, n, best) over all blocks: the documents that hold a pair linked, and whether no pair of its first id has more."""
    each = composed.select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.n_docs").alias("n"))
    each = settle(each, "pairs")
    first = F.shiftright("pair", 32)
    most = each.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # one row for each id of the first vocabulary at most
    return each.join(F.broadcast(most), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", n_best long, count_sum long, groups_sha256 string"


def _weigh(block: pa.Table, counted: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' counts: its sparse matrix times the pairs' counts."""
    counted = counted.take(pa.array(np.argsort(counted.column("place").to_numpy())))
    n, best = counted.column("n").to_numpy(), counted.column("best").to_numpy(zero_copy_only=False)
    doc, place = np.divmod(np.cumsum(_whole(block, "cells", "<i8")), max(len(n), 1))
    amount = _whole(block, "amount", "<u4").astype(np.int64)
    own = lambda c: block.column(c).chunk(0).flatten()
    indptr = np.searchsorted(doc, np.arange(len(own("doc_id")) + 1))
    sums = [_sums(amount * best[place], indptr), _sums(amount * n[place], indptr)]
    return pa.Table.from_arrays([own("doc_id"), *map(own, _COUNTS), *map(pa.array, sums), own("digest")], [c.split()[0] for c in RESULT.split(", ")])


def align_tokens(docs: DataFrame, path_a: str, path_b: str, *, block_bytes: int = 8 << 20) -> DataFrame:
    """Align the tokens of a byte-level tokenizer and of a sentencepiece model over every whole text of (doc_id, text).

    The first encodes a space and the text, the second the text, to which it
    adds the space; strings of special tokens are plain text. Returns one row a
    document: doc_id, n_a, n_b, n_groups (cut where tokens of both end), n_links
    (tokens of both that share a byte), n_best (links whose id pair is held by as many documents as
    any of its first id), count_sum (the documents that hold a link's id pair,
    summed over links), groups_sha256. Texts that are null, empty or that one of
    the tokenizers doesn't give back byte by byte have no tokens: zeros and an
    empty digest. Rows that repeat are documents of their own, a null doc_id stays null, extra columns are
    ignored. A text is cut only before white space that no
    entry of either vocabulary has after another character; where neither can be known, a segment is a whole text.
    """
    of = TokenBytes.load(path_a, path_b)
    wide = max(len(of.a), len(of.b)) > 1 << 16
    blocks = settle(segment_blocks(docs, of.splits, block_bytes=block_bytes), "blocks")
    found = align_segments(blocks.select("block", F.posexplode("segments").alias("place", "segment")), path_a, path_b, wide=wide)
    composed = settle(blocks.drop("segments").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_composer(wide), COMPOSED), "composed")
    forget(blocks)
    counted = composed.select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair")).join(pair_counts(composed), "pair").drop("pair")
    return composed.drop("pairs", "n_docs").groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_weigh, RESULT)
