"""op13 against a plain version: odd texts, repeats, ties, long words, many ranges."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from feedlens.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    (None, "a text without an id " * 9), (1, None), (1, "the same id twice " * 8), (1, "the same id twice " * 8), (2, ""), (3, " .,- "), (4, "Ünï CODE ÄÖ 中文 字符" * 5), (5, "x" * 5000 + " " + "y" * 47 + " " + "z" * 48 + " end" * 30),
    (6, "w " * 40_000), (-9, "A9 b8-C7_d6\x7fe5\x00f4  g3　h2 " * 4), (2**62, "big id " * 20),
]


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain(rows, target):
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    docs = [(i, *features(t)) for i, t in rows]
    s, t = Counter(bucket(g) for *_, gs in docs for g in gs), Counter(bucket(g) for x in target for g in features(x)[1])
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for i, words, gs in docs:
        weight = sum(gain(bucket(g)) for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    good = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for k, x in enumerate(good[: 25 * len(good) // 100], 1):
        x[5] = k
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def rows(spark, data):
    real = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    return ODD + [(10_000 + i, t) for i, t in real] + [(90_000 + i, "one of many equal copies " * 6) for i in range(100)]


def test_resample(spark, data, rows):
    target = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'c' as bucket", "*", "array(1) as place", "2 as rank").repartition(5)
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows, target)


def test_ranges_keep_the_order(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = importance.weigh(importance.count_matrix(docs, block_bytes=500), np.arange(10_000) % 7)
    few = importance.rank_drawn(scored, 60, len(rows)).collect()
    many = importance.rank_drawn(scored, 60, len(rows), range_rows=10).collect()
    assert sorted(map(tuple, few), key=repr) == sorted(map(tuple, many), key=repr)
    assert sorted(r.rank for r in many if r.rank) == list(range(1, 61))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none.select("text")).collect() == []
    some = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [(r.n_features, r.rank) for r in importance.resample(some, none.select("text")).collect()] == [(59, None)]


def test_blocks_hold_the_counts(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, None), (3, "b")], "doc_id long, text string").coalesce(1)
    (block,) = importance.count_matrix(docs).collect()
    assert block.doc_id == [1, 2, 3] and block.n_words == [4, 0, 1]
    assert np.frombuffer(block.indptr, "<i8").tolist() == [0, 4, 4, 5] and sorted(np.frombuffer(block.amount, "<u4").tolist()) == [1, 1, 2, 2, 2]
