"""Order-preserving packing of token streams into windows.

Documents in doc_id order form one stream of ids. A window ends at the end of
a document, at the end of a sentence or, inside very long sentences, anywhere
on a coarse grid. The cuts minimise padding plus truncation penalties by
dynamic programming: the best earlier cut of a full-cost window is the head of
a monotone queue; windows of exactly a power of two need no padding and are
looked up by position.
"""

from __future__ import annotations

import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import spans
from .common import arrow_map
from .token_binary import ordered_docs
from .tokenizing import chunk_ids


@dataclass(frozen=True)
class PackRules:
    """Penalties are in padding tokens."""

    window: int = 4096
    sentence_cut: int = 24
    forced_cut: int = 256
    grid: int = 512
    window_cost: int = 24
    least_power: int = 512
    run_ids: int = 2_000_000


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: np.ndarray, penalty: np.ndarray, rules: PackRules = PackRules()) -> np.ndarray:
    """Cuts of least total cost.

    ``at`` are the allowed cuts, ascending, from 0 to the stream's length, no
    two further apart than the window; ``penalty`` is the cost of cutting
    there. A window of n ids costs its padding to the full window, none at a
    power of two, and ``window_cost``. Returns the chosen positions with both ends.
    """
    n, size, each = len(at), rules.window, rules.window_cost
    exact: list[list[int]] = [[] for _ in range(n)]
    power = rules.least_power
    while power < size:
        i = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[np.minimum(i, n - 1)] == at - power)).tolist():
            exact[j].append(int(i[j]))
        power *= 2
    pos, pen = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    queue: deque[int] = deque()
    for j in range(1, n):
        i = j - 1
        g = cost[i] + pos[i]
        while queue and cost[queue[-1]] + pos[queue[-1]] >= g:
            queue.pop()
        queue.append(i)
        here = pos[j]
        while here - pos[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best = cost[i] + size - here + pos[i]
        for k in exact[j]:
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + pen[j] + each, i
    chosen, j = [n - 1], n - 1
    while j:
        j = back[j]
        chosen.append(j)
    return at[chosen[::-1]]


def _candidates(ends: np.ndarray, sentences: np.ndarray, rules: PackRules) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts and penalties: document ends free, sentence ends, and a grid in long gaps."""
    at = np.union1d(sentences, ends)
    at = np.concatenate([[0], at[at > 0]])
    gaps = np.diff(at)
    extra = [np.arange(at[g] + rules.grid, at[g + 1], rules.grid) for g in np.flatnonzero(gaps > rules.grid)]
    forced = np.concatenate(extra) if extra else np.zeros(0, np.int64)
    every = np.union1d(at, forced)
    pen = np.full(len(every), rules.sentence_cut, np.int64)
    pen[np.searchsorted(every, forced)] = rules.forced_cut
    pen[np.searchsorted(every, ends)] = 0
    return every, pen


def pack_run(doc_ids, lengths: np.ndarray, ids: np.ndarray, sentences: np.ndarray, rules: PackRules, first_sequence: int):
    """Pieces of one run of whole documents, as arrays in the order of SCHEMA, and the number of sequences."""
    ends = np.cumsum(lengths)
    at, pen = _candidates(ends, sentences, rules)
    cuts = best_cuts(at, pen, rules)
    edges = np.union1d(cuts, ends - lengths)
    edges = edges[edges < len(ids)]
    stop = np.append(edges[1:], len(ids))
    doc = np.searchsorted(ends, edges, side="right")
    seq = np.searchsorted(cuts, edges, side="right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges.tolist(), stop.tolist(), strict=True)), np.int64, len(edges))
    return [doc, edges - (ends - lengths)[doc], stop - edges, crc, lengths[doc], first_sequence + seq, edges - cuts[seq]], len(cuts) - 1


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 2, rules: PackRules = PackRules()) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``rules.window`` ids; one row per piece.

    Ranges of doc_id of about 8 MB of text, whatever the session's settings,
    are packed apart from each other, in runs of whole documents of about
    ``run_ids`` ids, so that memory stays bounded. Texts are cut for encoding
    only where the tokenizer's own normaliser and pre-tokeniser allow it. A null
    text counts as empty and gives one piece with the end id alone; rows that
    repeat are packed as often as they occur; a null doc_id stays null. The
    task's number stands in the upper bits of sequence_id.
    """

    def run(batches):
        table = chunk_ids(tokenizer)
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def flush():
            nonlocal sequence
            doc_ids = pa.concat_arrays([x[0] for x in held])
            lengths, ids = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            before = np.cumsum([0] + [len(x[2]) for x in held])
            sentences = np.concatenate([x[3] + b for x, b in zip(held, before, strict=False)])
            cols, made = pack_run(doc_ids, lengths, ids, sentences, rules, sequence)
            sequence += made
            return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(cols[0]))] + [pa.array(c.astype(np.int64)) for c in cols[1:]], [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for lo, hi, buf, offsets in spans.slices(batch.column(1)):
                ids, lengths, chunk, last = table.encode(buf, offsets, sentences=True)
                chunk_end = np.cumsum(chunk)
                stops = chunk_end[last]
                ends = np.cumsum(lengths)
                stops = stops + np.searchsorted(ends, stops, side="left")  # end ids of the texts before
                held.append((batch.column(0).slice(lo, hi - lo), lengths + 1, np.insert(ids, ends, np.uint32(end_id)), stops[stops > 0]))
                if sum(len(x[2]) for x in held) >= rules.run_ids:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return arrow_map(ordered_docs(docs), run, SCHEMA)
