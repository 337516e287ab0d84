"""op4, op6 and op8: held-out accuracy, and defined results at the edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.llm import chat, langid, toxicity
from feedlens.llm.common import held_out
from feedlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = QUERIES["op4_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_edges(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog are here", "en"), ("der Hund und die Katze sind da", "de")] * 20)] + [(100, None, None), (101, "", "en"), (102, "12 !! ..", "de"), (103, "x" * 30_000, None), (104, "中", None)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))
    model = langid.fit(docs, langid.CnnRules(epochs=3))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0.0 and all(0 <= r.score <= 1 for r in got.values()) and got[104].lang_pred in ("en", "de")
    none = spark.createDataFrame([], DOCS)
    assert langid.identify(none, langid.fit(none)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    m = langid.ByteCnn.fresh(["a", "b", "c"], langid.CnnRules(window=12, filters=3, embedding=2, widths=(2, 3)))
    m.weights = {k: v.astype(np.float64) for k, v in m.weights.items()}
    x, y = rng.integers(1, 6, (5, 12)).astype(np.uint8), rng.integers(0, 3, 5)
    m.training = True
    loss = lambda: -m.log_probabilities(x)[np.arange(5), y].mean()
    for name, g in m._gradients(x, y).items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in m.weights[name].shape)
            if name == "emb" and at[0] not in range(1, 6):
                continue
            before = m.weights[name][at]
            m.weights[name][at] = before + 1e-5
            up = loss()
            m.weights[name][at] = before - 1e-5
            down = loss()
            m.weights[name][at] = before
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4


@pytest.mark.parametrize("folder, recall, false_share, area", [("/root/testdata/sf0.1", 0.85, 0.01, 0.95), (FOLDER, 0.7, 0.02, 0.9)])
def test_toxicity_held_out(spark, folder, recall, false_share, area):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    ratios = model.curve[1 : 1 + model.rules.n_ratios]
    assert (ratios >= 0).all() and ratios[: len(model.rules.windows)].max() > 0
    truth = labels.where(held_out("doc_id", 3, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = toxicity.score_toxicity(docs, model).join(truth, "doc_id").collect()
    toxic, fine = (np.array([r.score for r in found if r.toxic == y]) for y in (1, 0))
    assert (toxic >= 0.7).mean() >= recall and (fine >= 0.7).mean() < false_share
    assert (toxic[:, None] > fine).mean() + (toxic[:, None] == fine).mean() / 2 >= area
    if folder == FOLDER:  # the query gives the same
        got = QUERIES["op8_toxicity"](spark, folder).where("held_out").join(truth, "doc_id").collect()
        assert {r.doc_id: r.predicted for r in got} == {r.doc_id: int(r.score >= 0.7) for r in found}


def test_toxicity_of_harmless_words(spark):
    """An expression whose words are as frequent in ordinary texts is learned as an expression."""
    rng = np.random.default_rng(5)
    fill = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("lo", "ren", "ti", "sk")]
    rows = []
    for i in range(600):
        words = list(rng.choice(fill, 40))
        for w in ("wooden", "spoon"):  # all texts have both, apart from each other
            words.insert(int(rng.integers(0, 20)) if w == "wooden" else int(rng.integers(25, 40)), w)
        if i % 4 == 0:
            words.insert(22, "wooden spoon")
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert model.curve[2 + len(model.rules.windows) : 1 + model.rules.n_ratios].max() > 0
    held = {r.doc_id for r in docs.where(held_out("doc_id", 3, 1)).collect()}
    got = [(r.predicted, rows[r.doc_id][2]) for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id in held]
    assert sum(p == y for p, y in got) > 0.95 * len(got)


def test_toxicity_keeps_every_ngram(spark):
    docs = spark.createDataFrame([(i, f"rare{i} word") for i in range(40)], "doc_id long, text string")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"))
    kept = [i for i in range(40) if not docs.where((F.col("doc_id") == i) & held_out("doc_id", 3, 1)).count()]
    buf = np.frombuffer(b" ".join(b"rare%d word" % i for i in kept), np.uint8)
    starts, ends, _ = toxicity.spans.words(buf, np.array([0, len(buf)]))
    assert set(toxicity.letter_grams(buf, starts, ends, 7)[1].tolist()) == set(model.letters.grams.tolist()) and len(model.pairs.load().grams) == 2 * len(kept)
    none = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic"), toxicity.ToxicRules(sample_bytes=60))
    assert 0 < len(none.pairs.load().grams) < len(model.pairs.load().grams)


def test_pair_ratios_against_plain_version(spark):
    """The joins give what the arrays give, for all texts and without each fold."""
    rng = np.random.default_rng(7)
    rules = toxicity.ToxicRules(folds=3, strength=2.0)
    grams = sorted({int(a) << 32 | int(b) for a, b in zip(rng.integers(1, 2**32, 30)[rng.integers(0, 30, 200)], rng.integers(1, 2**32, 20)[rng.integers(0, 20, 200)])})
    n = rng.poisson(0.5, (len(grams), 6))
    rows = [(int(np.uint64(g).view(np.int64)), *map(int, c)) for g, c in zip(grams, n)]
    pairs, contexts = toxicity.pair_ratios(spark.createDataFrame(rows, "gram long, " + ", ".join(f"n{k} int" for k in range(6))), rules)
    for name, without in (("r0", 0), ("r2", 2), ("all", None)):
        keep = [k for k in range(3) if k != without]
        toxic, ordinary = n[:, keep].sum(axis=1).astype(float), n[:, [3 + k for k in keep]].sum(axis=1).astype(float)
        some = toxic + ordinary > 0
        want = toxicity.kneser_ney(np.array(grams, np.uint64)[some], toxic[some], ordinary[some], rules, order=2, width=32)
        for df, key, keys, values in ((pairs, "gram", want.grams, want.gram_ratio), (contexts, "context", want.contexts, want.context_ratio)):
            got = {int(np.int64(r[key]).view(np.uint64)): r[name] for r in df.collect() if r[name] == r[name]}
            assert got.keys() == set(keys.tolist()) and np.allclose([got[k] for k in keys.tolist()], values, atol=1e-5)


def test_worst_windows_against_plain_version():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 3, 9, 0, 30])
    r = rng.normal(size=counts.sum()).round(1)
    for size in (1, 2, 4, 8):
        want, at = [], 0
        for n in counts:
            x = r[at : at + n]
            at += n
            w = sorted((x[i : i + size].sum() / size for i in range(max(n - size + 1, min(n, 1)))), reverse=True)[:3]
            want.append(sum(w) / 3)
        assert np.allclose(toxicity.worst_windows(r, counts, size, 3), want)
    x = toxicity.text_features(r, -r, counts, toxicity.ToxicRules())
    assert x.shape == (7, toxicity.ToxicRules().n_ratios + 1) and (x[0] == 0).all() and np.allclose(x[4, 4], r[6:15].mean())


def test_toxicity_edges(spark):
    rows = [(i, "you rotten scumbag get lost" if i % 2 else "we walk in the green park", i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(200, None), (201, ""), (202, "!!"), (203, "rotten " * 20_000), (203, "rotten " * 20_000)], "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 85 and by[1].predicted == 1 and by[2].predicted == 0 and by[200].score == by[201].score == by[202].score and all(r.predicted == int(r.score >= 0.7) for r in got)
    one_class = toxicity.fit(docs, labels.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score_toxicity(docs, one_class).collect())
    assert toxicity.drop_toxic(docs, toxicity.fit(docs, labels)).columns == docs.columns
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels)).count() == 0


@pytest.mark.parametrize("width", [8, 20])
def test_kneser_ney_against_plain_version(width):
    """Ratios of seen, unseen and unknown n-grams are those of probabilities that are written down one by one and sum to one."""
    from collections import Counter
    from math import isclose, log

    rng = np.random.default_rng(3)
    rules = toxicity.ToxicRules(order=3, strength=2.0)
    counts = {y: Counter(tuple(int(v) for v in rng.integers(5, [7, 9, 11])) for _ in range(n)) for y, n in ((1, 90), (0, 140))}
    both, d = counts[0] + counts[1], rules.discount
    kinds = {3: both}
    for k in (2, 1):  # how many different longer n-grams end in it
        kinds[k] = Counter(g[1:] for g in kinds[k + 1])

    def shared(g):
        if not g:
            return 1 / (256 if width == 8 else len(kinds[1]) + 1)
        after = {h: n for h, n in kinds[len(g)].items() if h[:-1] == g[:-1]}
        if not after:
            return shared(g[1:])
        return (max(after.get(g, 0) - d, 0) + d * len(after) * shared(g[1:])) / sum(after.values())

    def by_class(g, y):
        after = {h: n for h, n in counts[y].items() if h[:-1] == g[:-1]}
        total = sum(after.values())
        return (max(counts[y][g] - d, 0) + (d * len(after) + rules.strength) * shared(g)) / (total + rules.strength)

    packed = lambda g: sum(v << (width * k) for k, v in enumerate(reversed(g)))
    grams = np.array(sorted(map(packed, both)), np.uint64)
    n = [np.array([float(counts[y][tuple(int(g) >> s & (1 << width) - 1 for s in (2 * width, width, 0))]) for g in grams]) for y in (1, 0)]
    model = toxicity.kneser_ney(grams, *n, rules, width=width)
    contexts = sorted({g[:-1] for g in both})
    asked = [(*c, w) for c in [*contexts, (99, 98)] for w in range(256)]
    want = [log(by_class(g, 1) / by_class(g, 0)) for g in asked]
    assert np.allclose(model.ratios(np.array([packed(g) for g in asked], np.uint64)), want, atol=1e-5)
    assert any(abs(x) > 0.1 for g, x in zip(asked, want, strict=True) if g not in both)  # unseen letters do say something
    for c in contexts:
        for y in (0, 1):
            assert width != 8 or isclose(sum(by_class((*c, w), y) for w in range(256)), 1)


def by_line(rows):
    """Roles of all lines of each conversation, in order, and where turns begin."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.turn, getattr(r, "piece", 0))):
        roles, begins = out.setdefault(r.conv_id, ([], []))
        roles += [r.role_pred] * r.n_lines
        begins += [r.turn] * r.n_lines
    return out


def test_roles_held_out(spark):
    """Lines of held-out transcripts get their speakers, also more often than by repeating the last marker."""
    truth = spark.read.parquet(f"{FOLDER}/conversations.parquet").where(held_out("conv_id", 4, 2)).orderBy("conv_id", "turn").collect()
    found = QUERIES["op6_chat_format"](spark, FOLDER).collect()
    assert sum(r.n_rows for r in found) == spark.read.parquet(f"{FOLDER}/conversations.parquet").count()
    got = by_line([r for r in found if r.held_out])
    want = {}
    for r in truth:
        want.setdefault(r.conv_id, []).extend([r.role.lower()] * max(1, sum(1 for line in r.text.split("\n") if line.strip())))
    assert {c: len(x) for c, x in want.items()} == {c: len(x[0]) for c, x in got.items()}
    pairs = [(a, b) for c in want for a, b in zip(want[c], got[c][0], strict=True)]
    right = sum(a == b for a, b in pairs) / len(pairs)
    common = max(sum(a == r for a, _ in pairs) for r in chat.ROLES) / len(pairs)
    assert right > max(0.9, common + 0.1), (right, common)
    assert all(r.rendered.startswith("<|") and r.rendered.endswith("<|end|>\n") for r in found)


@pytest.fixture(scope="module")
def chat_model(spark):
    return chat.fit(chat.as_transcript(spark.read.parquet(f"{FOLDER}/conversations.parquet")))


def test_fit_counts(spark):
    """Probabilities of a small table, counted by hand."""
    rows = [(1, 0, "user", "User: a?\nb\nc"), (1, 1, "assistant", "Assistant: d\n\n- e"), (1, 2, "user", "f"), (2, 0, "System", "System: g"), (2, 1, None, "x"), (3, 0, "user", None)]
    m = chat.fit(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    s = m.rules.smoothing
    user, bot = 1, 2
    assert np.allclose(np.exp(m.start), [(1 + s) / (2 + 3 * s), (1 + s) / (2 + 3 * s), s / (2 + 3 * s), 0, 0, 0])
    total = 1 + 4 * s  # one move from a first line of a user's turn: inside it
    assert np.allclose(np.exp(m.move[user]), [s / total, s / total, s / total, 0, (1 + s) / total, 0])
    total = 2 + 4 * s  # from inside: once on, once to the assistant
    assert np.allclose(np.exp(m.move[3 + user]), [s / total, s / total, (1 + s) / total, 0, (1 + s) / total, 0])
    assert np.allclose(np.exp(m.move[3 + bot]), [s / (1 + 4 * s), (1 + s) / (1 + 4 * s), s / (1 + 4 * s), 0, 0, s / (1 + 4 * s)])
    assert np.allclose(np.exp(m.marker[user]), np.array([1 + s, s, 1 + s, s]) / (2 + 4 * s))
    assert np.allclose(np.exp(m.signal[user]), np.array([1 + s, 1 + s, s, s]) / (2 + 4 * s)) and np.allclose(np.exp(m.signal[3 + bot]), np.array([s, s, 1 + s, s]) / (1 + 4 * s))
    import pyarrow as pa

    seen = pa.table({"marker": [2, 0], "length": [3, 1], "signal": [1, 0]})
    assert np.allclose(chat.emissions(m, seen), [[m.marker[k, 2] + m.length[k, 3] + m.signal[k, 1] for k in range(6)], [m.marker[k, 0] + m.length[k, 1] + m.signal[k, 0] for k in range(6)]])


def test_viterbi_against_all_paths(chat_model):
    import itertools

    rng = np.random.default_rng(2)
    for n in (1, 2, 5):
        emit = rng.normal(size=(n, 6))
        best = max(itertools.product(range(6), repeat=n), key=lambda p: chat_model.start[p[0]] + sum(emit[k, s] for k, s in enumerate(p)) + sum(chat_model.move[a, b] for a, b in zip(p[:-1], p[1:], strict=True)))
        assert tuple(chat.viterbi(emit, chat_model.move, chat_model.start)) == best


def test_many_sequences_at_once(chat_model):
    """Side by side, in chunks with fixed ends and through joined matrices the states are those of one sequence alone."""
    rng = np.random.default_rng(9)
    sizes = np.array([3, 1, 7, 2, 7, 1])
    emit, move = rng.normal(size=(sizes.sum(), 6)), chat_model.move
    first = np.stack([chat_model.start] * len(sizes))
    first[2] = np.where(np.arange(6) == 4, 0.0, -np.inf)
    last = np.array([-1, -1, 1, -1, 5, -1])
    got = chat.viterbi_all(emit, sizes, move, first, last)
    for k, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        assert (got[a:b] == chat.viterbi(emit[a:b], move, first[k], None if last[k] < 0 else int(last[k]))).all()
    whole = chat.viterbi(emit, move, chat_model.start)
    one = np.where(np.eye(6, dtype=bool), 0.0, -np.inf)[None] + emit[:, None, :]
    stops = np.cumsum(sizes)
    best = np.stack([chat.joined_chunks(one[a:b], move) for a, b in zip(stops - sizes, stops)])
    assert chat.chunk_ends(best, move, chat_model.start, None) == [(whole[a], whole[b - 1]) for a, b in zip(stops - sizes, stops)]
    assert np.allclose(chat.joined_chunks(best, move), chat.joined_chunks(one, move))


PARTS = "conv_id long, place long, text string"


def test_a_transcript_over_many_ranges(spark, chat_model, monkeypatch):
    """Chunks of one transcript in ranges of two give what one range gives."""
    rows = [(1, t, f"User: {t}?" if t % 3 else "yes") for t in range(90)] + [(2, t, "Assistant: x\ny") for t in range(9)]
    from dataclasses import replace

    small = replace(chat_model, rules=chat.ChatRules(places=2))
    parts = spark.createDataFrame(rows, PARTS)
    want = sorted(map(tuple, chat.parse_transcripts(parts, small).collect()))
    ends = chat._fixed_ends
    monkeypatch.setattr(chat, "_fixed_ends", lambda lines, model: ends(lines, model, range_chunks=2))
    got = chat.parse_transcripts(parts, small)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 40


def test_chunks_change_nothing(spark, chat_model):
    """Whole or in small chunks, with crowded places, rows without ids or places, repeats and a very long text."""
    from dataclasses import replace

    rng = np.random.default_rng(4)
    some = lambda: str(rng.choice(["User: hi?", "ok", "Assistant: yes " * 9, "x " * int(rng.integers(1, 200)), "- a\n- b", "User: one\ntwo\nAssistant: three"]))
    rows = [(c, t, some()) for c in (1, 2) for t in range(50)] + [(None, 0, "a"), (3, None, None), (3, 0, "User: q?"), (5, 0, "User: " + "long " * 50_000)]
    rows += [(4, None, f"User: number {k}\nAssistant: yes") for k in range(40)] + [(4, 3, f"line {k}") for k in range(9)] + [(4, 70, "System: x")] * 30 + [(None, None, f"Q: {k}") for k in range(40)]
    parts = spark.createDataFrame(rows, PARTS).selectExpr("*", "'x' as conv", "1 as chunk", "2 as turn")
    whole = chat.parse_transcripts(parts, chat_model).collect()
    small = chat.parse_transcripts(parts, replace(chat_model, rules=chat.ChatRules(places=4, crowd=6))).collect()
    assert by_line(whole) == by_line(small) and len(small) > len(whole)
    text = lambda found: {c: "\n".join(r.text for r in sorted((r for r in found if r.conv_id == c), key=lambda r: (r.turn, r.piece))) for c in {r.conv_id for r in found}}
    assert text(whole) == text(small)
    for found in (whole, small):
        assert sum(r.n_rows for r in found) == len(rows) - 1 and sum(r.opens for r in found) == sum(r.closes for r in found) == len({(r.conv_id, r.turn) for r in found})
    rendered = lambda found: {c: "".join(r.rendered for r in sorted((r for r in found if r.conv_id == c), key=lambda r: (r.turn, r.piece))) for c in (1, 2, 4)}
    shape = "conv_id long, turn long, piece long, role_pred string, n_lines long, n_rows long, text string, opens boolean, closes boolean"
    assert rendered(chat.render(spark.createDataFrame(whole, shape)).collect()) == rendered(chat.render(spark.createDataFrame(small, shape)).collect())


def test_transcripts(spark, chat_model):
    docs = spark.createDataFrame([(1, 0, "System: be kind\n\nUser: what is this?\nAssistant: a test.\nUser: thanks"), (2, 0, None), (3, 0, ""), (4, 0, "User: a\nb\nc\nAssistant: d\ne")], PARTS)
    got = chat.render(chat.parse_transcripts(docs, chat_model)).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role_pred) for r in got] == [(1, "system"), (1, "user"), (1, "assistant"), (1, "user"), (4, "user"), (4, "assistant")]
    assert got[1].rendered == "<|user|>\nwhat is this?<|end|>\n" and got[4].rendered == "<|user|>\na\nb\nc<|end|>\n" and got[5].text == "Assistant: d\ne"


def test_transcripts_of_nothing(spark, chat_model):
    none = spark.createDataFrame([], PARTS)
    assert chat.parse_transcripts(none, chat_model).count() == 0
    empty = chat.fit(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    got = chat.parse_transcripts(spark.createDataFrame([(1, 0, "User: a")], PARTS), empty).collect()
    assert len(got) == 1 and got[0].role_pred in chat.ROLES


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", held_out("id", 3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in rows)


def test_rare_language_is_learned(spark):
    """Each language has a sample of its own, of all windows of its texts, and a text that repeats counts once."""
    docs = spark.range(1500).selectExpr("id AS doc_id", "IF(id >= 1490, 'rare', 'often') AS lang", "concat(repeat('abab ', IF(id < 1000, 20, 2000)), IF(id >= 1490, repeat('zqzq ', 4000), '')) AS text", "'x' AS lang_pred", "1 AS window")
    docs = docs.union(docs.where("doc_id = 3").crossJoin(spark.range(200)).drop("id"))
    model = langid.fit(docs, langid.CnnRules(sample=40, epochs=60))
    assert model.languages == ["often", "rare"]
    tests = spark.createDataFrame([(1, "abab " * 20, None), (2, "zqzq " * 300, None), (2, "zqzq " * 300, "x")], DOCS)
    got = langid.identify(tests, model).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, "often"), (2, "rare"), (2, "rare")]


def test_network_against_plain_version():
    """Filters, maxima, softmax and the vote of windows, written out byte by byte."""
    rng = np.random.default_rng(5)
    m = langid.ByteCnn.fresh(["a", "b", "c"], langid.CnnRules(window=10, filters=4, embedding=3, widths=(2, 3)))
    w = {k: v.astype(np.float64) for k, v in m.weights.items()}
    m.weights = w
    x = rng.integers(1, 9, (6, 10)).astype(np.uint8)
    for row, got in zip(x, m.log_probabilities(x), strict=True):
        pooled = []
        for k in (2, 3):
            seen = [np.concatenate([w["emb"][row[i + j]] for j in range(k)]) @ w[f"conv{k}"] + w[f"bias{k}"] for i in range(10 - k + 1)]
            pooled += [max(0.0, max(y[f] for y in seen)) for f in range(4)]
        z = np.array(pooled) @ w["out"] + w["out_bias"]
        assert np.allclose(got, z - np.log(np.exp(z).sum()))
    texts = [b"abcdefghijklm", b"", b"xy"]
    offsets = np.cumsum([0, *map(len, texts)])
    windows, doc = langid.byte_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, 10)
    assert [bytes(r).rstrip(b"\0") for r in windows] == [b"abcdefghij", b"klm", b"xy"] and doc.tolist() == [0, 0, 2]


def test_votes_weigh_bytes(spark):
    rules = langid.CnnRules(window=16, filters=4, embedding=3)
    m = langid.ByteCnn.fresh(["a", "b", "c"], rules)
    text = "some letters of more than two windows of text"
    got = langid.identify(spark.createDataFrame([(1, text, None)], DOCS), m).first()
    raw = text.encode()
    parts = [raw[i : i + 16] for i in range(0, len(raw), 16)]
    vote = sum(len(p) * m.log_probabilities(np.frombuffer(p.ljust(16, b"\0"), np.uint8)[None])[0] for p in parts) / len(raw)
    p = np.exp(vote) / np.exp(vote).sum()
    assert got.lang_pred == "abc"[p.argmax()] and abs(got.score - p.max()) < 1e-5


def test_no_language_known(spark):
    docs = spark.createDataFrame([(1, "some text", None)], DOCS)
    got = langid.identify(docs, langid.fit(docs)).first()
    assert (got.lang_pred, got.score) == ("und", 0.0)
