"""op2, op10 and components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from feedlens.llm import embed_dedup, minhash
from feedlens.llm.components import components

DOCS = "doc_id long, text string"


def lowest(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000 + rng.randrange(400), 1000 + rng.randrange(400)) for _ in range(300)] + [(5000, 5000), (7000, 6000), (6000, 7000)] + [(8000, 8000 + k) for k in range(300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    want = {k: v for k, v in lowest({x for ab in links for x in ab}, links).items() if k != v}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else Counter([tuple(w)] if w else [])


def near_classes(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and (sets[a] & sets[b]).total() >= threshold * (sets[a] | sets[b]).total()]
    return lowest(ids, links)


def family(rng, words, n, edits):
    """n texts, each an edit of the one before: chains whose ends differ."""
    out = [rng.choices(words, k=60)]
    for _ in range(n - 1):
        w = list(out[-1])
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("rules", [minhash.NearRules(), minhash.NearRules(small=2, tile=8)])
def test_near_duplicates(spark, rules):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [t for n, edits in ((40, 1), (25, 2), (8, 3), (30, 0)) for t in family(rng, words, n, edits)]
    texts += ["a b c d e " * k for k in (1, 4, 5, 20, 21)]
    texts += [None, "", "  \n", "one two", "One  TWO", "x" * 50_000, "a b c d e", "a b c d f", " ".join(rng.choices(words, k=30_000))]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[0], (None, "a b c d e")], DOCS).selectExpr("*", "'x' as bands", "1 as key_a")
    got = minhash.near_duplicates(df, rules).collect()
    assert len(got) == len(rows) + 1
    want = near_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_near_duplicates_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    pool = rng.integers(1, 2**63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 200).astype(float), rng.integers(1, 9, 200).astype(float)
    a, b = pool[:200], pool[100:]
    sig = minhash.dart_signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([200, 200]), 4096)
    least, most = np.minimum(wa[100:], wb[:100]).sum(), np.maximum(wa[100:], wb[:100]).sum() + wa[:100].sum() + wb[100:].sum()
    assert abs((sig[0] == sig[1]).mean() - least / most) < 0.035


def test_weights_count(spark):
    rows = [(1, "a b c d e " * 10), (2, "a b c d e " * 9), (3, "a b c d e")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    plain = {r.doc_id: r.class_id for r in minhash.near_duplicates(df, minhash.NearRules(weighted=False)).collect()}
    assert plain == {1: 1, 2: 1, 3: 3}


def test_expanded_sets_are_weighted_ones():
    rng = np.random.default_rng(8)
    value = np.sort(rng.integers(1, 2**63, 50).astype(np.uint64))
    wa, wb = rng.integers(1, 6, 50), rng.integers(1, 6, 50)
    (a, na), (b, nb) = (minhash.expanded(value, w, np.array([50])) for w in (wa, wb))
    assert (na[0], nb[0]) == (wa.sum(), wb.sum()) and (np.diff(a) > 0).all()
    assert minhash.similarity(a, b) == np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()


def test_hot_bucket(spark):
    """Hundreds of near copies of one text, two families of which meet in buckets: all salts and tiles at work."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=120)
    rows = []
    for k in range(260):
        w = list(base)
        for at in rng.sample(range(120), 1 + k % 5):
            w[at] = rng.choice(words)
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), minhash.NearRules(small=4, tile=16, salts=4)).collect()}
    assert got == near_classes(rows)


VECTORS = "vec_id long, embedding array<float>, label int"


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1, None):
        for c in range(12):
            center = rng.normal(size=16)
            rows += [(center + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12]), label) for _ in range(12)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [float("inf")] + [1.0] * 15, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [], 0)]
    rows += [(n + 6 + k, [2.0 * x for x in rows[5][1]], 0) for k in range(3)]  # the same direction, longer
    valid = {i: np.array(v, dtype=np.float64) for i, v, label in rows if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: la for i, _, la in rows}
    unit = {i: v / np.sqrt(v @ v) for i, v in valid.items()}
    links = [(a, b) for a in unit for b in unit if a < b and label[a] == label[b] and unit[a] @ unit[b] >= 0.98]
    want = lowest([i for i, _, _ in rows], links)
    degree = {i: 0 for i, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert len(links) > 200
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as rep", "2 as often", "3 as salt", "4 as block")
    for rules in (embed_dedup.TileRules(), embed_dedup.TileRules(rows=8, strip=5, hot=3, salts=2), embed_dedup.TileRules(block_bytes=5 * 8 * 16)):
        got = embed_dedup.near_vectors(df, rules).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (degree[i], want[i]) for i, _, _ in rows}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_of_nothing(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    got = embed_dedup.near_vectors(spark.createDataFrame([(1, None, 1), (2, [1.0], None)], VECTORS)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (2, 0, 2, True)}
