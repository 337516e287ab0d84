"""op11 against whole-text encoding by both libraries."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from feedlens.llm import align
from feedlens.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n\t b\r\n\r\nc", "\nfoo bar", "  x y  z", "a　 b  c  d", "trailing   \n ", "tab\tand\x0bvert\x0cfeed", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "literal ▁ marker", "Ünïcode—dash “quotes” 中文字符 日本語 😀👩‍👩‍👧", "don't we'll 'S it's", "x" * 30_000, "word " * 5_000, "\x00\x01\x1c a \x1f b \x7f", "1234567890 12 3 !!!###$$$ ... ,,, ||", "é é é", "a" * 300 + " " + "b " * 50,
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), align.TokenBytes.load(A, B)


def plain(rows, both):
    """By whole texts and by every byte: which tokens cover it."""
    a, b, of = both
    out, held = [], Counter()
    for i, text in rows:
        ids = ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = [b"".join(t[k] for k in x) for t, x in zip((of.a, of.b), ids)]
            if raw != [(" " + text).encode()] * 2:
                ids = ([], [])
        owner = [[k for k, x in enumerate(part) for _ in t[x]] for t, part in zip((of.a, of.b), ids)]
        links = sorted(set(zip(*owner)))
        ends = [{sum(len(t[x]) for x in part[: k + 1]): k + 1 for k in range(len(part))} for t, part in zip((of.a, of.b), ids)] if text and len(text) < 2000 else None
        pairs = Counter((ids[0][x], ids[1][y]) for x, y in links)
        held.update(pairs.keys())
        digest, n_groups = None, None
        if ends is not None or not ids[0]:
            cuts = sorted(set(ends[0]) & set(ends[1])) if ends else []
            at, parts = (0, 0), []
            for c in cuts:
                to = ends[0][c], ends[1][c]
                parts.append("|".join(",".join(map(str, part[lo:hi])) for part, lo, hi in zip(ids, at, to)))
                at = to
            digest, n_groups = hashlib.sha256(";".join(parts).encode()).hexdigest() if ids[0] else "", len(parts)
        out.append((i, len(ids[0]), len(ids[1]), n_groups, len(links), pairs, digest))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    return [(i, n_a, n_b, n_g, n_l, sum(k for p, k in pairs.items() if held[p] == most[p[0]]), sum(k * held[p] for p, k in pairs.items()), d) for i, n_a, n_b, n_g, n_l, pairs, d in out]


def same(found, wanted):
    key = lambda r: tuple(-1 if x is None else x for x in r[:3])
    found, wanted = sorted(found, key=key), sorted(wanted, key=key)
    assert [r[:3] + r[4:7] for r in found] == [r[:3] + r[4:7] for r in wanted]
    assert all(f[3] == w[3] and f[7] == w[7] for f, w in zip(found, wanted) if w[7] is not None)


def test_vocabularies_allow_the_cuts(both):
    assert " " in both[2].splits and "\n" in both[2].splits and "\r" not in both[2].splits  # the second one joins marks with a carriage return
    assert align.joining(["a b", "a\n", "\t a", "  ", "\xa0\t", "abc"]) == {" ", "\n"}


@pytest.mark.parametrize("block_bytes", [300, 4 << 20])
def test_align_odd(spark, both, block_bytes):
    rows = [(i if i else None, t) for i, t in enumerate(ODD)] + [(7, "one of many copies of a text")] * 40 + [(None, "no id")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("1 as block", "*", "map('a', 1) as pairs", "2 as n_a").repartition(3)
    same([tuple(r) for r in align.align_tokens(docs, A, B, block_bytes=block_bytes).collect()], plain(rows, both))


def test_query(spark, data, both):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op11_alignment"](spark, data)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same([tuple(r) for r in found.collect()], plain(rows, both))


def test_empty_table(spark):
    assert align.align_tokens(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_whole_texts_where_cuts_are_not_safe(spark, both, tmp_path, monkeypatch):
    with open(A, encoding="utf-8") as f:
        definition = json.load(f)
    del definition["added_tokens"]
    first = next(i for e, i in definition["model"]["vocab"].items() if i == 50_000)
    definition["model"]["vocab"] = {("aĠb" if i == first else e): i for e, i in definition["model"]["vocab"].items()}
    definition["model"]["merges"] = [m for m in definition["model"]["merges"] if "aĠb" not in "".join(m)]
    path = tmp_path / "joins.json"
    path.write_text(json.dumps(definition), encoding="utf-8")
    assert " " not in align.TokenBytes.load(str(path), B).splits
    rows = [(i, t) for i, t in enumerate(ODD) if t and len(t) < 100]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = align.segment_blocks(docs, "").collect()
    assert sorted(s for b in blocks for s in b.segments) == sorted({" " + t for _, t in rows})
    found = [tuple(r) for r in align.align_tokens(docs, A, B).collect()]
    monkeypatch.setattr(align, "joining", lambda entries: set(align._ASCII_WHITE))
    same([tuple(r) for r in align.align_tokens(docs, A, B).collect()], found)


def test_alignment_of_segments(both):
    tokens = align.SegmentTokens(A, B)
    texts = [" a", "\n b", " ▁", "   ", " ", " don't", " " + "x" * 40, " 中文"]
    a, b, steps, n_a, n_b, n_steps = tokens.align(texts, *tokens.encode(texts))
    assert n_a[2] == n_b[2] == 0 and n_steps[2] == 1
    groups = align.group_texts(a, b, steps, n_a, n_b)
    n_steps = np.where(n_a > 0, n_steps, 0)
    for text, group, links in zip(texts, groups, n_steps.tolist(), strict=True):
        ids = tokens.encode([text])
        raw = [[of[i] for i in x[0]] for of, x in zip((tokens.of_a, tokens.of_b), ids)]
        owner = [[k for k, t in enumerate(part) for _ in t] for part in raw]
        assert links == (len(set(zip(*owner))) if "▁" not in text else 0)
        told = [tuple(int(i) for g in group.decode().split(";") if g for i in g.split("|")[k].split(",")) for k in (0, 1)]
        assert told == [tuple(x[0]) if links else () for x in ids]
