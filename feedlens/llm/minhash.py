"""Near-duplicate documents by DartMinHash.

Darts are thrown at the region of each weighted shingle, in the order of their
ranks; a document keeps, for each of K coordinates, the earliest dart that hits
one of its regions. Darts depend on the shingle alone, so two documents agree in
a coordinate with the probability of their weighted Jaccard similarity. A
shingle weighs as often as it occurs in its text. Bands of coordinates make
candidates, which a comparison of the whole weighted sets by 64-bit hashes confirms.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import forget, map_batches, settle
from .components import components, star_forest

U64 = np.uint64
_STEP, _SIDE, _NAME = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearRules:
    """A link is a weighted Jaccard similarity of ``threshold`` or more over ``words``-word shingles.

    A pair at the threshold itself misses all bands with probability
    (1 - threshold ** rows) ** bands, 0.0005 here. A shingle weighs as often as
    it occurs in the text; without ``weighted`` every shingle weighs 1. What one
    pivot doesn't join is compared pair by pair in buckets of ``small`` at most,
    in larger ones by tiles of ``tile`` documents a side. ``salts`` is the
    number of parts that rows of one key are dealt into.
    """

    words: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 7
    weighted: bool = True
    small: int = 32
    tile: int = 256
    salts: int = 32


def dart_signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(sets, k) 32-bit signatures of weighted sets.

    ``elements`` are 64-bit hashes, ``counts`` of them for each set; every set
    needs one at least, with positive weights. The region of an element is its
    weight, in strips [0,1), [1,2), [2,4), ...; darts arrive in a strip as a
    Poisson process along the rank axis, of its width's intensity.
    """
    n_sets = len(counts)
    out = np.full(n_sets * k, _EMPTY, U64)
    owner = np.repeat(np.arange(n_sets), counts)
    weights = weights.astype(np.float64)
    total = np.bincount(owner, weights=weights, minlength=n_sets)
    n_strips = np.where(weights <= 1, 1, 1 + np.ceil(np.log2(np.maximum(weights, 1)))).astype(np.int64)
    row = np.repeat(np.arange(len(elements)), n_strips)
    strip = np.arange(len(row)) - np.repeat(np.cumsum(n_strips) - n_strips, n_strips)
    width = np.where(strip == 0, 1.0, 2.0 ** (strip - 1.0))
    floor = np.where(strip == 0, 0.0, width)
    whole = weights[row] >= floor + width
    start = spans.mix(elements[row] ^ (strip.astype(U64) * _SIDE + U64(seed) * _NAME))
    set_of, room = owner[row], weights[row] - floor
    limit = (k * math.log(max(k, 2)) + 2 * k) / total
    todo = np.ones(n_sets, bool)
    while todo.any():
        active = np.flatnonzero(todo[set_of])
        expected = limit[set_of[active]] * width[active]
        for block in (1, 4, 16, 64):
            lowest, highest = {1: (0, 0.4), 4: (0.4, 3), 16: (3, 14), 64: (14, np.inf)}[block]
            mine = active[(expected >= lowest) & (expected < highest)]
            step = max(1, 500_000 // block)
            for lo in range(0, len(mine), step):
                _throw(mine[lo : lo + step], block, start, width, room, whole, set_of, limit, out, k)
        todo = (out.reshape(n_sets, k) == _EMPTY).any(axis=1)
        out.reshape(n_sets, k)[todo] = _EMPTY
        limit = np.where(todo, limit * 2, limit)
    return (out & U64(0xFFFFFFFF)).astype(np.uint32).reshape(n_sets, k)


def _throw(rows, block, start, width, room, whole, set_of, limit, out, k) -> None:
    rank = np.zeros(len(rows))
    number = np.zeros(1, U64)
    while len(rows):
        who = (number + np.arange(1, block + 1, dtype=U64)) * _STEP
        dart = spans.mix(start[rows][:, None] + who[None, :])
        gap = -np.log(((dart >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[rows][:, None]
        ranks = rank[:, None] + np.cumsum(gap, axis=1)
        bound = limit[set_of[rows]]
        hit = ranks <= bound[:, None]
        if not whole[rows].all():
            place = (spans.mix(dart ^ _SIDE) >> U64(11)).astype(np.float64) * 2.0**-53 * width[rows][:, None]
            hit &= place < room[rows][:, None]
        at = np.nonzero(hit)
        name = spans.mix(dart[at] ^ _NAME)
        coordinate = ((name >> U64(32)) * U64(k)) >> U64(32)
        early = (ranks[at] / bound[at[0]] * 4294967295.0).astype(U64)
        np.minimum.at(out, set_of[rows[at[0]]] * k + coordinate.astype(np.int64), (early << U64(32)) | (name & U64(0xFFFFFFFF)))
        go = ranks[:, -1] <= bound
        rows, rank = rows[go], ranks[go, -1]
        number = number + U64(block)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int):
    """Different shingles of each text, sorted: (hashes, how often each, number per text, word counts, sequence keys).

    A text of fewer words than a shingle has all its words as its only shingle.
    """
    starts, ends, n_words = spans.words(buf, offsets)
    h = spans.hash_spans(buf, starts, ends)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(h)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    keys = []
    for salt in (_SIDE, _NAME):
        term = np.zeros(len(h) + 1, U64)
        np.cumsum(spans.mix(h ^ spans.mix(place.astype(U64) + salt)), out=term[1:])
        cut = np.concatenate([[0], np.cumsum(n_words)])
        keys.append(spans.mix(term[cut[1:]] - term[cut[:-1]] + n_words.astype(U64)))
    w, at = spans.windows(h, n_words, size)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    value, owner = np.concatenate([w, keys[0][short]]), np.concatenate([doc[at], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    often = np.diff(np.append(first, len(value)))
    return value[first], often, np.bincount(owner[first], minlength=len(n_words)), n_words, keys


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def signatures(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, key_a, key_b, bands, n_shingles): a key of the word sequence, one hash for each band, and the weight of all shingles.

    Words are lower-cased runs without ASCII white space. A document without
    words, null included, has null keys and no bands.
    """
    k = rules.bands * rules.rows

    def make():
        def f(batch: pa.RecordBatch):
            for lo, hi, buf, offsets in spans.slices(_lower(batch.column(1)), 1 << 20):
                value, often, per_set, n_words, keys = shingle_sets(buf, offsets, rules.words)
                some = np.flatnonzero(per_set > 0)
                sig = dart_signatures(value, often if rules.weighted else np.ones(len(value)), per_set[some], k)
                band = np.repeat(spans.mix(np.arange(1, rules.bands + 1, dtype=U64) * _STEP)[None, :], len(some), axis=0)
                cells = sig.reshape(len(some), rules.bands, rules.rows).astype(U64)
                for r in range(rules.rows):
                    band = spans.mix(band * U64(3) ^ (cells[:, :, r] + U64(1)))
                none = n_words == 0
                weight = np.bincount(np.repeat(np.arange(hi - lo), per_set), weights=often if rules.weighted else None, minlength=hi - lo).astype(np.int64)
                ends = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(np.where(none, 0, rules.bands), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo)] + [pa.array(x.view(np.int64), mask=none) for x in keys] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(band.ravel().view(np.int64))), pa.array(weight)],
                    ["doc_id", "key_a", "key_b", "bands", "n_shingles"],
                )

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, key_a long, key_b long, bands array<long>, n_shingles long")


def expanded(value: np.ndarray, often: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sets as plain ones: the n-th occurrence of a shingle is an element of its own.

    Jaccard similarities of the plain sets are the weighted ones. Returns the
    elements, sorted inside each set, and how many each set has.
    """
    row = np.repeat(np.arange(len(value)), often)
    nth = (np.arange(len(row)) - np.repeat(np.cumsum(often) - often, often)).astype(U64)
    element = np.where(nth == 0, value[row], spans.mix(value[row] + nth * _STEP))
    owner = np.repeat(np.arange(len(counts)), counts)[row]
    order = np.lexsort((element, owner))
    return element[order], np.bincount(owner, minlength=len(counts))


def _sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame, rules: NearRules) -> DataFrame:
    """(doc_id, shingles) of the wanted documents: the elements of the weighted set as sorted 64-bit hashes in bytes.

    One row for each row of ``docs``; of the ``repeated`` ids one for each different text.
    """

    def make():
        def f(batch: pa.RecordBatch):
            for lo, hi, buf, offsets in spans.slices(_lower(batch.column(1)), 1 << 20):
                value, often, per_set, _, _ = shingle_sets(buf, offsets, rules.words)
                if rules.weighted:
                    value, per_set = expanded(value, often, per_set)
                ends = np.concatenate([[0], np.cumsum(per_set)]).tolist()
                rows = [value[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "shingles"])

        return f

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    found = docs.join(wanted, "doc_id", "left_semi")
    if not repeated.isEmpty():
        found = found.join(repeated, "doc_id", "left_anti").union(found.join(repeated, "doc_id", "left_semi").distinct())
    return map_batches(found, make, "doc_id long, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of different values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _salt(rules: NearRules, column: str):
    return F.pmod(F.xxhash64(column), F.lit(rules.salts)).cast("int")


def _salted(df: DataFrame, rules: NearRules) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))))


def _verify(pairs: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold.

    b may be in very many pairs: they are dealt by (b, salt of a), and b's set
    goes only where it has pairs.
    """

    def make():
        def f(batch: pa.RecordBatch):
            a, b, sa, sb = batch.columns
            keep = []
            for x, y in zip(sa, sb, strict=True):
                u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                keep.append(min(len(u), len(v)) >= rules.threshold * max(len(u), len(v)) and similarity(u, v) >= rules.threshold)
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return f

    dealt = pairs.withColumn("salt", _salt(rules, "a"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = dealt.select("b", "salt").distinct().join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    joined = dealt.join(left, "a").join(right, ["b", "salt"]).select("a", "b", "sa", "sb")
    return map_batches(joined, make, "a long, b long")


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)) numbers of common values of sets, by products of 0/1 matrices."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    row_a, row_b = np.repeat(np.arange(len(a)), list(map(len, a))), np.repeat(np.arange(len(b)), list(map(len, b)))
    common = np.intersect1d(flat_a, flat_b)
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(common):
        return out
    at_a, at_b = np.searchsorted(common, flat_a), np.searchsorted(common, flat_b)
    in_a, in_b = np.append(common, 0)[at_a] == flat_a, np.append(common, 0)[at_b] == flat_b
    in_a, in_b = in_a & (at_a < len(common)), in_b & (at_b < len(common))
    order_a, order_b = np.argsort(at_a[in_a], kind="stable"), np.argsort(at_b[in_b], kind="stable")
    at_a, row_a, at_b, row_b = at_a[in_a][order_a], row_a[in_a][order_a], at_b[in_b][order_b], row_b[in_b][order_b]
    for lo in range(0, len(common), 4096):
        x, y = np.zeros((len(a), 4096), np.float32), np.zeros((len(b), 4096), np.float32)
        for m, at, row in ((x, at_a, row_a), (y, at_b, row_b)):
            p, q = np.searchsorted(at, [lo, lo + 4096])
            m[row[p:q], at[p:q] - lo] = 1
        out += x @ y.T
    return out


def _compare(table: pa.Table, rules: NearRules) -> pa.Table:
    """One tile of a bucket: a spanning forest of the links between its two blocks (or inside the one)."""
    table = table.combine_chunks()
    side, ids, comp = (table.column(c).to_numpy() for c in ("right", "id", "comp"))
    sets = [np.frombuffer(x.as_buffer(), U64) for x in table.column("shingles")]
    p, q = np.flatnonzero(~side), np.flatnonzero(side)
    q = q if len(q) else p
    size = np.array(list(map(len, sets)), np.float64)
    both = _overlaps([sets[i] for i in p], [sets[j] for j in q]).astype(np.float64)
    near = both / np.maximum(1, size[p][:, None] + size[q][None, :] - both)
    i, j = np.nonzero((near >= rules.threshold) & (comp[p][:, None] != comp[q][None, :]))
    v, u = star_forest(ids[p[i]], ids[q[j]])
    return pa.table({"a": v, "b": u})


def _tile_links(rows: DataFrame, sets: DataFrame, rules: NearRules) -> DataFrame:
    """Links between the components of large buckets, from rows (bucket, id, comp).

    A bucket is dealt into blocks of bounded size, those of a large component
    apart from the rest; blocks of one component aren't compared. Rows meet
    the sizes of their bucket's parts by salted keys.
    """
    rows = rows.withColumn("salt", _salt(rules, "id"))
    large = rows.groupBy("bucket", "comp").count().where(F.col("count") >= rules.tile // 2)
    placed = rows.join(_salted(large.select("bucket", "comp", F.lit(True).alias("own")), rules), ["bucket", "comp", "salt"], "left")
    placed = settle(placed.select("bucket", "id", "comp", "salt", F.coalesce("own", F.lit(False)).alias("own"), F.when(F.col("own"), F.col("comp")).otherwise(F.lit(0)).alias("part")), "placed")
    shape = placed.groupBy("bucket", "own", "part").agg(F.ceil(F.count("*") / rules.tile).cast("int").alias("m"))
    dealt = placed.join(_salted(shape, rules), ["bucket", "own", "part", "salt"])
    dealt = dealt.select("bucket", "id", "comp", F.struct("own", "part", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("m")).cast("int").alias("k")).alias("block"))
    blocks = shape.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).select("bucket", F.struct("own", "part", "k").alias("block"))
    tiles = blocks.withColumnRenamed("block", "one").join(blocks.withColumnRenamed("block", "two"), "bucket")
    tiles = tiles.where("(one < two or (one = two and not one.own)) and not (one.own and two.own and one.part = two.part)")
    first = dealt.withColumnRenamed("block", "one").join(tiles, ["bucket", "one"]).select("bucket", "one", "two", "id", "comp", F.lit(False).alias("right"))
    second = dealt.withColumnRenamed("block", "two").join(tiles.where("one <> two"), ["bucket", "two"]).select("bucket", "one", "two", "id", "comp", F.lit(True).alias("right"))
    full = first.union(second).join(sets.withColumnRenamed("doc_id", "id"), "id")
    return full.groupBy("bucket", "one", "two").applyInArrow(lambda t: _compare(t, rules), "a long, b long")


def near_duplicates(docs: DataFrame, rules: NearRules = NearRules()) -> DataFrame:
    """(doc_id, copy_of, class_id, kept) of every document with an id.

    Texts of equal words are one text, named by its smallest doc_id (copy_of);
    texts are linked by similarity, and class_id is the smallest doc_id that
    links reach. kept is true for that document alone. A document without words
    is a class of its own; of rows that repeat a doc_id, equal ones share a
    result, and different texts of one doc_id link what any of them is near to;
    null ids are dropped, as nothing could name them.

    All members of a bucket are compared with its smallest one. What then still
    lies in different components of one bucket is compared pair by pair, in large
    buckets inside tiles that return a spanning forest. Nothing is capped: a
    bucket whose members are all in one component is done.
    """
    signed = settle(signatures(docs, rules).where("doc_id is not null"), "signed")
    keys = ["key_a", "key_b"]
    texts = signed.where("key_a is not null").groupBy(*keys).agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n"))
    groups = _salted(texts.where("n > 1").select(*keys, "copy_of"), rules)
    member = settle(
        signed.withColumn("salt", _salt(rules, "doc_id"))
        .join(groups, [*keys, "salt"], "left")
        .select("doc_id", F.coalesce("copy_of", "doc_id").alias("copy_of"), F.when(F.coalesce("copy_of", "doc_id") == F.col("doc_id"), F.col("bands")).alias("bands"), "n_shingles"),
        "member",
    )
    repeated = settle(signed.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    forget(signed)
    rows = member.where("bands is not null").select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"), "n_shingles")
    first = F.struct("id", "n_shingles")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min(first).alias("pivot")).where("n > 1")
    # a bucket of very many near copies is one key: merge joins let adaptive execution split it
    buckets = settle(rows.join(shared.hint("merge"), "bucket").select("bucket", "id", "n_shingles", "pivot", "n"), "buckets")
    wanted = settle(buckets.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    sets = settle(_sets(docs, wanted, repeated, rules), "sets")
    like = lambda a, b: F.least(a, b) >= rules.threshold * F.greatest(a, b)  # noqa: E731  (sizes of texts that can be near)
    stars = buckets.where((F.col("id") != F.col("pivot.id")) & like("n_shingles", "pivot.n_shingles")).select(F.col("id").alias("a"), F.col("pivot.id").alias("b")).distinct()
    stars = settle(_verify(stars, sets, rules), "links")
    comps = components(stars)
    labelled = buckets.join(comps, buckets.id == comps.node, "left").select("bucket", "id", "n_shingles", "n", F.coalesce("root", "id").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    still = settle(labelled.join(mixed.hint("merge"), "bucket"), "mixed")
    if not still.isEmpty():
        few = still.where(F.col("n") <= rules.small)
        left = few.select("bucket", F.col("id").alias("a"), F.col("comp").alias("ca"), F.col("n_shingles").alias("na"))
        right = few.select("bucket", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("n_shingles").alias("nb"))
        pairs = left.join(right, "bucket").where((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b")) & like("na", "nb")).select("a", "b").distinct()
        more = settle(_verify(pairs, sets, rules).union(_tile_links(still.where(F.col("n") > rules.small).select("bucket", "id", "comp"), sets, rules)), "links")
        comps = components(more.select(F.col("a").alias("v"), F.col("b").alias("u")).union(comps))
    forget(sets, buckets, still)
    out = member.join(comps, member.copy_of == comps.node, "left").select("doc_id", "copy_of", F.coalesce("root", "copy_of").alias("class_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("class_id"))
