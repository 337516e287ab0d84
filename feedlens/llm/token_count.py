"""Edit-aware token counts.

A document's state holds a segment tree of some pre-token chunks a leaf:
characters, bytes and tokens of every leaf and the sums of every subtree. An edit
is found by descent from the root, re-encodes only the leaves it touches and, where
it touches a boundary, their neighbours, and puts their new counts into the same
leaves; then the sums on the paths above them are updated. The tree is built
again only where a region has grown to many times its leaves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import map_batches
from .tokenizing import chunk_ids

LEAF_CHUNKS = 16
#: A region of more than so many times its leaves gets a new tree.
CROWDED = 8
SUMS = ("chars", "bytes", "tokens")
STATE = "doc_id long, text string, n_tokens long, tree_chars array<int>, tree_bytes array<int>, tree_tokens array<int>"


class SegmentForest:
    """The trees of many documents in one array for each of SUMS.

    A tree of ``room`` leaves, a power of two, takes 2 * room cells from
    ``base`` on: the root is cell 1, the children of cell k are 2k and 2k + 1,
    and cell 0 is unused. Leaves may be empty.
    """

    def __init__(self, base: np.ndarray, room: np.ndarray, sums: dict[str, np.ndarray]):
        self.base, self.room, self.sums = base, room, sums

    @classmethod
    def grow(cls, leaves: dict[str, np.ndarray], counts: np.ndarray) -> SegmentForest:
        """Trees over ``counts`` leaves for each document, which stand one after the other."""
        room = (1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)).astype(np.int64)
        base = np.cumsum(2 * room) - 2 * room
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        sums = {}
        for name in SUMS:
            sums[name] = np.zeros(int(2 * room.sum()), np.int64)
            sums[name][base[doc] + room[doc] + place] = leaves[name]
        out = cls(base, room, sums)
        width = int(room.max(initial=1)) // 2
        while width:
            tall = np.flatnonzero(room >= 2 * width)
            for x in sums.values():
                low = base[tall, None] + 2 * np.arange(width, 2 * width)
                x[base[tall, None] + np.arange(width, 2 * width)] = x[low] + x[low + 1]
            width //= 2
        return out

    @classmethod
    def of_lists(cls, lists: dict[str, pa.ListArray]) -> SegmentForest:
        ends = lists["tokens"].offsets.to_numpy().astype(np.int64)
        return cls(ends[:-1] - ends[0], np.diff(ends) // 2, {name: lists[name].flatten().to_numpy().astype(np.int64) for name in SUMS})

    def lists(self) -> list[pa.ListArray]:
        size = 2 * self.room
        at = np.repeat(self.base - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(self.sums[name][at].astype(np.int32))) for name in SUMS]

    def total(self, name: str) -> np.ndarray:
        return self.sums[name][self.base + 1]

    def find(self, docs: np.ndarray, places: np.ndarray, by: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The leaf of each document that holds a place, counted ``by`` one of SUMS, and all sums before that leaf.

        A place at the end or beyond leads to the last leaf.
        """
        cell, left = np.ones(len(docs), np.int64), places.copy()
        before = {name: np.zeros(len(docs), np.int64) for name in SUMS}
        base, room = self.base[docs], self.room[docs]
        while True:
            go = np.flatnonzero(cell < room)
            if not len(go):
                return cell - room, before
            low = base[go] + 2 * cell[go]
            right = left[go] >= self.sums[by][low]
            skipped = go[right]
            for name in SUMS:
                before[name][skipped] += self.sums[name][low[right]]
            left[skipped] -= self.sums[by][low[right]]
            cell[go] = 2 * cell[go] + right

    def leaf(self, doc: int, k: int, name: str) -> int:
        return int(self.sums[name][self.base[doc] + self.room[doc] + k])

    def put(self, docs: np.ndarray, first: np.ndarray, last: np.ndarray, leaves: list[dict[str, np.ndarray]]) -> None:
        """New leaves for leaves first..last of each document (no document twice)."""
        touched, crowded = [], []
        for d, a, b, new in zip(docs.tolist(), first.tolist(), last.tolist(), leaves, strict=True):
            slots, n = b - a + 1, len(new["tokens"])
            if n > CROWDED * slots:
                crowded.append((d, a, b, new))
                continue
            at = self.base[d] + self.room[d] + a
            cut = np.arange(slots) * n // slots if n > slots else None
            for name, x in self.sums.items():
                x[at : at + slots] = 0
                x[at : at + min(n, slots)] = new[name] if cut is None else np.add.reduceat(new[name], cut)
            touched.append((d, a, b))
        if touched:
            d, a, b = np.array(touched).T
            doc = np.repeat(d, b - a + 1)
            cell = self.room[doc] + np.repeat(a, b - a + 1) + np.arange(len(doc)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1)
            while (cell > 1).any():
                up = cell > 1
                doc, cell = np.unique(np.stack([doc[up], cell[up] >> 1]), axis=1)
                at = self.base[doc] + 2 * cell
                for x in self.sums.values():
                    x[at - cell] = x[at] + x[at + 1]
        if crowded:
            parts = []
            for d, a, b, new in crowded:
                own = {name: x[self.base[d] + self.room[d] : self.base[d] + 2 * self.room[d]] for name, x in self.sums.items()}
                parts.append({name: np.concatenate([x[:a], new[name], x[b + 1 :]]) for name, x in own.items()})
                used = parts[-1]["bytes"] > 0
                parts[-1] = {name: x[used] for name, x in parts[-1].items()}
            fresh = SegmentForest.grow({name: np.concatenate([p[name] for p in parts]) for name in SUMS}, np.array([len(p["tokens"]) for p in parts]))
            for k, (d, *_) in enumerate(crowded):
                self.base[d], self.room[d] = fresh.base[k] + len(self.sums["tokens"]), fresh.room[k]
            self.sums = {name: np.concatenate([x, fresh.sums[name]]) for name, x in self.sums.items()}


def _leaves(buf: np.ndarray, offsets: np.ndarray, chunk_tokens: np.ndarray, starts: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Leaves of texts and their numbers: runs of chunks of one text, cut before a space where there is one."""
    doc = np.searchsorted(offsets, starts, side="right") - 1
    place = np.arange(len(starts)) - np.searchsorted(starts, offsets[:-1])[doc]
    first = np.flatnonzero((place % LEAF_CHUNKS == 0) & ((place == 0) | (buf[starts] == 0x20)))
    counts = np.bincount(doc[first], minlength=len(offsets) - 1)
    if not len(first):
        return {name: np.zeros(0, np.int64) for name in SUMS}, counts
    ends = np.append(starts[first[1:]], offsets[-1])
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    return {"chars": chars[ends] - chars[starts[first]], "bytes": ends - starts[first], "tokens": np.add.reduceat(chunk_tokens, first)}, counts


def build_state(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text, n_tokens and the tree) of every (doc_id, text); a null text counts as empty, rows that repeat have states of their own."""

    def make():
        table = chunk_ids(tokenizer)

        def f(batch: pa.RecordBatch):
            for lo, hi, buf, offsets in spans.slices(batch.column(1)):
                _, n, chunk, _ = table.encode(buf, offsets)
                forest = SegmentForest.grow(*_leaves(buf, offsets, chunk, table.cuts(buf, offsets)))
                text = pc.fill_null(batch.column(1).slice(lo, hi - lo), "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), text, pa.array(n), *forest.lists()], [c.split()[0] for c in STATE.split(", ")])

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, STATE)


class _Batch:
    """Texts under edits, with their trees."""

    def __init__(self, texts: list[bytes], forest: SegmentForest, table):
        self.texts, self.forest, self.table = texts, forest, table
        self.encoded = np.zeros(len(texts), np.int64)

    def _byte(self, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The byte where each character place lies: by descent, and inside one leaf."""
        leaf, before = self.forest.find(docs, places, "chars")
        out = before["bytes"].copy()
        for k in np.flatnonzero(places > before["chars"]).tolist():
            a = int(before["bytes"][k])
            inside = self.texts[docs[k]][a : a + self.forest.leaf(docs[k], int(leaf[k]), "bytes")].decode()
            out[k] += len(inside[: int(places[k] - before["chars"][k])].encode())
        return out

    def edit(self, docs: np.ndarray, edits: list[dict]) -> None:
        """One edit for each of some documents.

        A boundary of leaves stands if the space that it lies before, and the
        byte after that, are not edited; what lies left of it doesn't matter.
        """
        n = self.forest.total("chars")[docs]
        at = np.clip(np.array([e.get("at") or 0 for e in edits], np.int64), 0, n)
        to = np.minimum(at + np.maximum(np.array([e.get("remove") or 0 for e in edits], np.int64), 0), n)
        start, stop = self._byte(docs, at), self._byte(docs, to)
        first, before = self.forest.find(docs, np.maximum(start - 2, 0), "bytes")
        last, until = self.forest.find(docs, np.maximum(stop - 1, 0), "bytes")
        regions = []
        for k, d in enumerate(docs.tolist()):
            raw, a, b = self.texts[d], int(start[k]), int(stop[k])
            new = (edits[k].get("insert") or "").encode()
            end = int(until["bytes"][k]) + self.forest.leaf(d, int(last[k]), "bytes")
            regions.append(raw[int(before["bytes"][k]) : a] + new + raw[b:end])
            self.texts[d] = raw[:a] + new + raw[b:]
            self.encoded[d] += len(regions[-1])
        buf = np.frombuffer(b"".join(regions), np.uint8)
        offsets = np.zeros(len(regions) + 1, np.int64)
        np.cumsum([len(r) for r in regions], out=offsets[1:])
        _, _, chunk, _ = self.table.encode(buf, offsets)
        leaves, counts = _leaves(buf, offsets, chunk, self.table.cuts(buf, offsets))
        cut = np.cumsum(counts)[:-1]
        parts = {name: np.split(x, cut) for name, x in leaves.items()}
        self.forest.put(docs, first, last, [{name: parts[name][k] for name in SUMS} for k in range(len(docs))])


def apply_edits(state: DataFrame, edits: DataFrame | None, tokenizer: str) -> DataFrame:
    """New states after edits (doc_id, edits array<struct<at int, remove int, insert string>>).

    ``at`` and ``remove`` count characters of the text as it is when its turn
    comes; edits apply in the order of the array, positions beyond the end mean
    the end, nulls mean 0 or nothing. Documents without edits keep their state;
    edits of unknown or null ids are ignored. Several rows of edits of one id
    are put together in their sorted order; every row of a repeated doc_id is edited.
    Adds n_tokens_before, bytes_encoded and n_edits. The first edits of many
    documents are encoded together, then the second ones, and so on.
    """
    schema = STATE + ", n_tokens_before long, bytes_encoded long, n_edits long"
    names = [c.split()[0] for c in schema.split(", ")]

    def make():
        table = chunk_ids(tokenizer)

        def part(batch: pa.RecordBatch):
            get = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            forest = SegmentForest.of_lists({name: get[f"tree_{name}"] for name in SUMS})
            work = _Batch([(t or "").encode() for t in get["text"].to_pylist()], forest, table)
            changes = [[x or {} for x in e or []] for e in get["edits"].to_pylist()]
            for turn in range(max(map(len, changes))):
                docs = np.array([d for d, e in enumerate(changes) if len(e) > turn])
                work.edit(docs, [changes[d][turn] for d in docs])
            cols = [get["doc_id"], pa.array([t.decode() for t in work.texts], pa.string()), pa.array(forest.total("tokens")), *forest.lists(), get["n_tokens"], pa.array(work.encoded), pa.array(list(map(len, changes)), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names)

        def f(batch: pa.RecordBatch):
            for lo, hi, *_ in spans.slices(batch.column(batch.schema.names.index("text"))):
                yield part(batch.slice(lo, hi - lo))

        return f

    state = state.select(*[c.split()[0] for c in STATE.split(", ")], *(["edits"] if edits is None else []))
    if edits is not None:
        edits = edits.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.flatten(F.array_sort(F.collect_list("edits"))).alias("edits"))
        state = state.join(edits, "doc_id", "left")
    return map_batches(state, make, schema)


def apply_own_edits(state_with_edits: DataFrame, tokenizer: str) -> DataFrame:
    """As ``apply_edits``, for a state that has its own column ``edits``, null for none: no join is needed."""
    return apply_edits(state_with_edits, None, tokenizer)
