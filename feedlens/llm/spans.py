"""Word and chunk spans over Arrow text columns, found and hashed with numpy.

A batch of texts is one byte buffer with offsets, so words of thousands of
documents are located and hashed by a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The ASCII white space that ends a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([0] + [(1 << (8 * r)) - 1 for r in range(1, 9)], dtype=U64)
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x ^= x >> U64(33)
    x *= _M2
    x ^= x >> U64(33)
    return x


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets from 0). A null counts as an
    empty text; a row longer than the limit is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte) inside each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and number per text of the runs without ASCII white space."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = SPACE[buf]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = space
    before[offsets] = True
    starts = np.flatnonzero(before[:-1] & ~space)
    after = np.empty(n + 1, bool)
    after[n] = True
    after[:-1] = space
    after[offsets] = True
    ends = np.flatnonzero(after[1:] & ~space) + 1
    cuts = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(cuts)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    length = ends - starts
    h = mix(length.astype(U64) * _GOLD + U64(1))
    if not len(starts):
        return h
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    at, left, who = starts, length, None
    while True:
        block = eight[at] & _MASK[np.minimum(left, 8)]
        if who is None:
            h = mix(h ^ (block + _GOLD))
        else:
            h[who] = mix(h[who] * U64(3) ^ (block + _GOLD))
        more = left > 8
        if not more.any():
            return h
        who = np.flatnonzero(more) if who is None else who[more]
        at, left = at[more] + 8, left[more] - 8


def windows(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` neighbouring words of one text, and where each starts.

    ``h`` are word hashes, ``counts`` the words of each text. Returns (hash,
    index of its first word), in order.
    """
    n = len(h)
    if n < size:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(n) + size <= ends)
    out = np.zeros(len(at), U64)
    for k in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + h[at + k]
    return mix(out), at
