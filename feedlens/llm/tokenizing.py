"""Whole-text tokenisation by the tokenizers library, one call for each different chunk.

A text is cut only where the tokenizer's own pre-tokenisation must cut it, so
the ids of the chunks in a row are the ids of the text. A worker keeps the ids
of the chunks it has met; what a table of bounded size forgets is encoded again.
"""

from __future__ import annotations

import json
import os

import numpy as np

from . import spans

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
#: Bytes that can begin a character which surely isn't white space: visible ASCII, and lead bytes of blocks without any.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[[0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xCB, *range(0xCE, 0xE0), *range(0xE4, 0xEE)]] = True
#: ASCII marks that no letter shares a pre-token with; an apostrophe may begin a contraction.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:#*$%&|()[]{}\"/\\@^~=_+<>-"]] = True
_MARK[ord("<")] = _MARK[ord(">")] = _MARK[ord("|")] = _MARK[ord("_")] = False  # parts of special tokens

#: Characters that end a sentence, in any script; the wide ones stand before a letter without a space.
SENTENCE_ENDS = ".!?…。！？｡।॥؟۔።։"
_WIDE_ENDS = "。！？"
_WHOLE, _BYTES, _FOLDED = "whole", "bytes", "folded"
#: The patterns by which byte-level tokenizers keep visible words, and the white space they replace.
_KEPT_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACES = r"\s+"


def _codes(chars: str) -> dict[int, np.ndarray]:
    """The UTF-8 bytes of characters as numbers, by length."""
    out: dict[int, list[int]] = {}
    for raw in (c.encode() for c in chars):
        out.setdefault(len(raw), []).append(int.from_bytes(raw, "big"))
    return {n: np.array(sorted(v)) for n, v in out.items()}


def _last_code(buf: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes before each end as one number."""
    code = np.zeros(len(ends), np.int64)
    for k in range(length, 0, -1):
        code = code << 8 | np.where(ends >= k, buf[np.maximum(ends - k, 0)], 0).astype(np.int64)
    return code


def ends_sentence(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character before each position ends a sentence."""
    out = np.zeros(len(ends), bool)
    if len(buf):
        for length, codes in _codes(SENTENCE_ENDS).items():
            out |= np.isin(_last_code(buf, ends, length), codes)
    return out


def cutting_of(definition: dict) -> str:
    """How a tokenizer's own normaliser and pre-tokeniser let texts be cut.

    ``bytes``: byte-level pre-tokens of the text as it is. ``folded``: lower
    case, white space dropped between words. Any other tokenizer gets its texts
    ``whole``, as nothing is known about where it can't join characters.
    """
    normal, pre = definition.get("normalizer"), definition.get("pre_tokenizer") or {}
    if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return _BYTES
    steps, words = (normal or {}).get("normalizers", []), pre.get("pretokenizers", [])
    known = all(s["type"] in ("NFC", "Lowercase") or (s["type"] == "Replace" and s["pattern"] == {"Regex": _SPACES} and s["content"] == " ") for s in steps)
    folds = known and any(s["type"] == "Lowercase" for s in steps)
    if folds and len(words) == 2 and words[0]["type"] == "Split" and words[0]["behavior"] == "Removed" and words[0]["invert"] and words[0]["pattern"] == {"Regex": _KEPT_WORDS}:
        if words[1]["type"] == "ByteLevel" and not words[1]["add_prefix_space"] and not words[1]["use_regex"]:
            return _FOLDED
    return _WHOLE


def text_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of non-empty texts: the only cuts of a tokenizer whose texts stay whole."""
    return offsets[:-1][np.diff(offsets) > 0]


def cuts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted positions where a chunk starts, the start of each non-empty text among them.

    Cuts lie before a single space or around a single line feed between
    characters that aren't white space, between a letter and a mark, and between
    a wide sentence end and an ideograph.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    solid = _SOLID[buf]
    ink = ~spans.SPACE[buf] & (buf >= 0x21) & (buf < 0x7F)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        # buf[i] is a space or line feed, the byte before is visible ASCII, the next begins a visible character
        gap = (buf[1:-1] == 0x20) & solid[2:]
        line = (buf[1:-1] == 0x0A) & solid[2:] & ink[:-2]
        cut[1 : n - 1] |= gap | line
        cut[2:n] |= line
    cut[1:n] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    wide = np.flatnonzero((buf >= 0xE4) & (buf <= 0xE9))
    cut[wide[np.isin(_last_code(buf, wide, 3), _codes(_WIDE_ENDS)[3])]] = True
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


class ChunkIds:
    """Token ids of chunks, kept by chunk hash in sorted order."""

    def __init__(self, path: str, capacity: int = 1_000_000):
        self.fold, self.capacity, self.cuts = False, capacity, cuts
        self.tokenizer = self.load(path)
        self.reset()

    def load(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            how = cutting_of(json.load(f))
        self.fold = how == _FOLDED
        if how == _WHOLE:
            self.cuts = text_starts
        return Tokenizer.from_file(path)

    def encode_chunks(self, chunks: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """Ids of each chunk, and a mark of each that stays with it."""
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [e.ids for e in found], np.zeros(len(chunks), np.uint8)

    def reset(self):
        self.hashes = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.marks = np.zeros(0, np.uint8)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, new: np.ndarray, chunks: list[str]) -> None:
        if len(self.hashes) + len(new) > self.capacity:
            self.reset()
        for lo in range(0, len(chunks), 20_000):
            found, marks = self.encode_chunks(chunks[lo : lo + 20_000])
            length = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(length.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            begin = self.used + np.cumsum(length) - length
            self.used += len(flat)
            base = len(self.start)
            self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, length])
            self.marks = np.concatenate([self.marks, marks])
            part = new[lo : lo + 20_000]
            at = np.searchsorted(self.hashes, part)  # both sorted
            self.hashes = np.insert(self.hashes, at, part)
            self.where = np.insert(self.where, at, base + np.arange(len(part)))

    def chunk_rows(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The row of each chunk in the table, encoding those not yet there."""
        h = spans.hash_spans(buf, starts, ends)
        distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[at[inside] * 0 + np.flatnonzero(inside)]
        if not known.all():
            if len(self.hashes) + int((~known).sum()) > self.capacity or self.used > 16 * self.capacity:
                self.reset()
                known[:] = False
            new = first[~known]
            raw = buf.tobytes()
            self._add(distinct[~known], [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, distinct)
        return self.where[at][back]

    def encode(self, buf: np.ndarray, offsets: np.ndarray, sentences: bool = False):
        """(ids of all texts in a row, ids of each text, ids of each chunk, with ``sentences`` whether each chunk ends one)."""
        if self.fold:
            upper = (buf >= 0x41) & (buf <= 0x5A)
            buf = np.where(upper, buf | 0x20, buf)
        starts = self.cuts(buf, offsets)
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        last = ends_sentence(buf, ends) if sentences else None
        per_text = np.searchsorted(starts, offsets)
        if self.fold and len(starts):  # this tokenizer drops white space: one row with or without the space before
            lead = (buf[starts] == 0x20) & (ends - starts > 1)
            rows = self.chunk_rows(buf, starts + lead, ends)
        else:
            rows = self.chunk_rows(buf, starts, ends)
        self.rows, self.per_text = rows, per_text
        length = self.length[rows].astype(np.int64)
        before = np.cumsum(length) - length
        total = int(length.sum())
        ids = self.ids[np.repeat(self.start[rows] - before, length) + np.arange(total)]
        summed = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(length, out=summed[1:])
        return ids, summed[per_text[1:]] - summed[per_text[:-1]], length, last


_KEPT: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """The table of this worker process for one tokenizer file."""
    if path not in _KEPT:
        _KEPT[path] = ChunkIds(path)
    return _KEPT[path]
