"""op1, op3, op5, op7 and op9 against plain versions and round trips."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from feedlens.llm import packing, quality, spm, token_binary, token_count
from feedlens.llm.queries import QUERIES

DOCS = "doc_id long, text string"
ODD = [
    None, "", " \n\t ", "one", "Ünïcode—dash “quotes” 中文 字符 日本語", "a b c　d", "tab\tand\x0bvertical\x0cfeed\r\nline", "don't we'll it's 'S", "<|endoftext|> <|startoftext|> </w> ▁ piece", "1234567890 12 3", "!!!###$$$ ... ,,, || <<>>",
    "A | B | C | D\nHome | About | Contact\nA sentence stands here.\nA sentence stands here.\n\nAll rights reserved.", "word " * 3000, "x" * 40_000, "Emoji 😀😃 👩‍👩‍👧 é é", "\u0085   ends", "UPPER lower MiXeD İ ß", "a" * 300 + " " + "b " * 50, "the cat sat on the mat and then ran off " * 8,
]


@pytest.fixture(scope="module")
def docs(spark, data):
    real = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    return real.union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(ODD)], DOCS)).selectExpr("*", "1 as n_words", "'x' as start").persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for found in at.values() if len(found) > 1 for i in found for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base(docs, texts):
    got = quality.judge_lines(docs).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got} == {i: base_counts(t) for i, t in texts.items()}
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_lines(spark):
    good = ["Every morning the baker opens the small shop near the station.", "Rivers carry sand and stones down from the hills to the sea.", "Nobody in the village could remember such a long and cold winter.", "She wrote three letters before noon and posted none of them."]
    text = "\n".join(["Home | About | Contact", *good, "Read more", "!!! ### $$$"])
    lost = "\n".join(["a | b | c | d | e | f | g"] * 3 + ["One sentence that ends, with some more words so that there are twenty words in all of this text."])
    df = spark.createDataFrame([(1, text, 5), (2, lost, 5), (3, None, None)], DOCS + ", n_chars long")
    got = {r.doc_id: r for r in quality.judge_lines(df, cleaned=True).collect()}
    assert (got[1].n_lines_navigation, got[1].n_lines_boilerplate, got[1].n_lines_punctuation, got[1].kept) == (1, 1, 1, True) and got[1].text.count("\n") == 3
    assert not got[2].kept and got[2].n_lines_navigation == 3 and not got[3].kept
    (kept,) = quality.clean_documents(df).collect()
    assert kept.doc_id == 1 and kept.text == got[1].text and kept.n_chars == len(kept.text)


SCRIPTS = {
    "hi": "आज सुबह बाजार में बहुत भीड़ थी और लोग सब्जियाँ खरीद रहे थे।\nशाम को हम सब नदी के किनारे टहलने गए और देर तक बातें करते रहे।",
    "ar": "ذهب الأولاد إلى المدرسة في الصباح الباكر مع أصدقائهم ومعلمهم الجديد؟\nعاد الجميع إلى البيت قبل غروب الشمس بعد يوم طويل وجميل في الحديقة۔",
    "zh": "今天早上市场里人很多，大家都在买新鲜的蔬菜和水果，孩子们在旁边的空地上高兴地玩耍。\n晚上我们一起到河边散步，一直聊到很晚才回家，路上的灯光照在水面上非常好看。",
    "th": "วันนี้ ตลาด มี คน มาก และ ทุกคน ซื้อ ผัก สด ใหม่ ทุก วัน",
    "fr": "« Bonjour », dit le boulanger à la vieille dame qui entrait dans la boutique.",
}


def test_quality_of_scripts(spark):
    """Sentences of any script pass, menus and paths with any separator don't."""
    df = spark.createDataFrame(list(enumerate(SCRIPTS.values())), DOCS)
    for r in quality.judge_lines(df).collect():
        assert (r.n_lines_navigation, r.n_lines_punctuation, r.n_lines_boilerplate) == (0, 0, 0), list(SCRIPTS)[r.doc_id]
    hindi = spark.createDataFrame([(1, SCRIPTS["hi"])], DOCS)
    assert quality.judge_lines(hindi).first().kept
    menus = ["Home » Products » About", "Home · Products", "首页 | 产品 | 关于", "الرئيسية › الأخبار › اتصل بنا", "http://a.example/x www.b.example", "A | B | C"]
    unended = ["आज सुबह बाजार में बहुत भीड़ थी और लोग सब्जियाँ खरीद रहे थे", SCRIPTS["zh"].split("\n")[0][:-1].replace("，", "") + "他们说明天还要再来"]
    notices = ["© 2021 Ein Verlag.", "Alle Rechte vorbehalten.", "版权所有。", "Tous DROITS RÉSERVÉS."]
    listed = ["• Milk and bread", "»Guten Tag«, sagte sie.", "A single · dot inside a line that ends as a sentence does.", "See http://a.example/x for more about the rivers of this land."]
    for column, lines in (("n_lines_navigation", menus), ("n_lines_punctuation", unended), ("n_lines_boilerplate", notices), (None, listed)):
        for r in quality.judge_lines(spark.createDataFrame(list(enumerate(lines)), DOCS)).collect():
            found = {c for c in ("n_lines_navigation", "n_lines_punctuation", "n_lines_boilerplate") if r[c]}
            assert found == ({column} if column else set()), lines[r.doc_id]


def test_quality_sql_of_scripts(spark):
    """The SQL follows the rules on every script, on odd texts and on no text at all."""
    import duckdb

    from feedlens.llm.queries import ORACLE_SQL
    from tests.compare import assert_same

    lines = [*SCRIPTS.values(), "Home » Products » About", "» a » b", "«a» » b", "首页|产品|关于", "www.a.de www.b.de", "© 2021", "POLÍTICA DE PRIVACIDAD.", "„x“ — !!! ???", *ODD]
    for texts in (lines + lines[:2] + ["\n".join(x for x in lines if x)], []):
        df = spark.createDataFrame(list(enumerate(texts)), DOCS)
        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        if texts:
            con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in enumerate(texts)])
        assert_same(quality.judge_lines(df), con, ORACLE_SQL["op1_quality_rules"])


def test_quality_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rates = {r.quality: r.kept for r in QUERIES["op1_quality_rules"](spark, folder).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.1


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def encodings(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def test_token_files(docs, texts):
    want, start = {}, 0
    for i, ids in sorted(encodings("byte_bpe_50k.json", texts).items()):
        want[i] = (start, len(ids) + 1, crc([*ids, 0]))
        start += len(ids) + 1
    got = token_binary.token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_token_files_of_nothing_and_repeats(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_binary.token_files(spark.createDataFrame([], DOCS), path).count() == 0
    got = token_binary.token_files(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (-(2**63), "c")], DOCS), path).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=lambda r: r[1]) == [(None, 0, 2), (-(2**63), 2, 2), (1, 4, 2), (1, 6, 2)]


def test_columns_named_like_results(spark):
    """Extra columns that clash with those of a result change nothing."""
    rows = [(1, "some words here"), (2, None), (3, "and more of them"), (None, "x")]
    plain = spark.createDataFrame(rows, DOCS)
    clash = plain.selectExpr("'a' as start", "1.5 as n_tokens", "map('k', 1) as ids_crc32", "array(1) as n_ids", "'p' as parity", "doc_id", "'l' as length", "true as sequence_id", "text", "2 as offset", "3 as place", "'h' as hash", "4 as doc_tokens")
    bytes_, words_, pieces = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
    for run in (lambda d: token_binary.token_files(d, bytes_), lambda d: packing.pack_documents(d, words_).drop("sequence_id"), lambda d: spm.sp_encode(d, pieces)):
        assert sorted(map(str, run(clash).collect())) == sorted(map(str, run(plain).collect()))


def test_many_ranges(spark):
    """Ranges of a few bytes: one doc_id with many texts, a text that repeats, null ids; ids stay in order and nothing is lost."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(5, f"text {k} of one id") for k in range(40)] + [(7, "again")] * 40 + [(None, f"no id {k}") for k in range(40)] + [(k, None) for k in range(100, 110)]
    want = encodings("byte_bpe_50k.json", dict(enumerate(t for _, t in rows)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    dealt = token_binary.ordered_docs(docs, range_bytes=100)
    assert dealt.rdd.getNumPartitions() > 10
    parts = [[(r.doc_id if r.doc_id is not None else -1) for r in p] for p in dealt.rdd.glom().collect()]
    assert [i for p in parts for i in p] == sorted(-1 if i is None else i for i, _ in rows) and max(map(len, parts)) < 40
    manifest = token_binary.write_tokens(docs, f"file://{__import__('tempfile').mkdtemp()}/t", path, range_bytes=100)
    files = manifest.orderBy("first_token").collect()
    assert len(files) > 5 and [f.first_token for f in files] == [sum(g.n_tokens for g in files[:k]) for k in range(len(files))]
    got = sorted(token_binary.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [sum(g.n_tokens for g in got[:k]) for k in range(len(got))]
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    assert sorted(r.ids_crc32 for r in got) == sorted(crc([*ids, 0]) for ids in want.values())


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 5000])
@pytest.mark.parametrize("top", [1, 200, 50_000, 2**32])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n + top % 1000)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, top, n), rng.integers(0, max(1, top // 500), n)).astype(np.uint32)
    data = token_binary.encode_shard(np.array([7]), np.array([n]), ids)
    assert (token_binary.decode_ids(data) == ids).all()
    assert (token_binary.decode_ids(data, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    if n == 5000 and top == 50_000:
        assert len(data) < 0.6 * 4 * n
    with pytest.raises(ValueError):
        token_binary.read_index(b"x" * 100)


def test_packing(docs, texts):
    want = {i: [*ids, 2] for i, ids in encodings("word_bpe_49k.json", texts).items()}
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(want[i]) and p.ids_crc32 == crc(want[i][at : at + p.length])
            at += p.length
        assert at == len(want[i])
    padded = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
        total += at
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded < 0.05 * total


def test_packing_of_nothing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).count() == 0
    got = packing.pack_documents(spark.createDataFrame([(1, None), (1, "a"), (None, "b")], DOCS), path).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 2), (1, 1), (1, 2)]


def test_cuts_are_optimal():
    """The queue gives the cost of trying all cuts."""
    rng = np.random.default_rng(1)
    rules = packing.PackRules(window=64, least_power=8)
    for _ in range(30):
        at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 30, 25))]))
        pen = rng.integers(0, 40, len(at))
        size = lambda n: 0 if n in (8, 16, 32, 64) else 64 - n
        best = [0.0] + [np.inf] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + size(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 64) + pen[j] + rules.window_cost
        cuts = packing.best_cuts(at, pen, rules)
        cost = sum(size(b - a) + rules.window_cost + pen[np.searchsorted(at, b)] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        assert cost == best[-1]


def test_sentencepiece(spark, docs, texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = spm.sp_encode(docs, path, with_ids=True)
    rows = {r.doc_id: r for r in got.collect()}
    want = {i: sp.encode(t or "") for i, t in texts.items()}
    wrong = [i for i in want if rows[i].ids != want[i]]
    assert not wrong, [(texts[i][:50], rows[i].ids[:10], want[i][:10]) for i in wrong[:3]]
    assert all(r.parity and r.ids_crc32 == crc(r.ids) for r in rows.values())
    back = {r.doc_id: r.text for r in spm.sp_decode(got, path).collect()}
    assert all(back[i] == (t or "") for i, t in texts.items() if rows[i].round_trip) and sum(r.round_trip for r in rows.values()) > 0.95 * len(rows)
    assert spm.sp_encode(spark.createDataFrame([], DOCS), path).count() == 0


def model_file(path, pieces, kind, *, squeeze=True, prefix=True):
    """A SentencePiece model of given (piece, score, type), written by hand."""
    import struct

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 0x7F | 0x80, number >> 4, value]) if number > 15 else bytes([number << 3, value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        size = len(value)
        return bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value

    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, kind) + (field(35, 1) if any(k == spm.BYTE for *_, k in pieces) else b""))
    out += field(3, field(1, b"identity") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("kind", [spm.UNIGRAM, spm.BPE])
def test_models_of_whole_texts(spark, tmp_path, kind):
    """Unigram models and models that squeeze spaces, with byte fallback: ids of sentencepiece."""
    import sentencepiece

    special = [("<unk>", 0, spm.UNKNOWN), ("<s>", 0, spm.CONTROL), ("</s>", 0, spm.CONTROL)] + [(f"<0x{b:02X}>", 0, spm.BYTE) for b in range(256)]
    words = ["▁", "t", "h", "e", "c", "a", "s", "n", "th", "▁th", "▁the", "at", "c" + "at", "▁c", "▁cat", "▁sat", "an", "he", "▁a", "en"]
    path = model_file(tmp_path / "m.model", special + [(w, -1.5 - 0.37 * k, spm.NORMAL) for k, w in enumerate(words)], kind)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = dict(enumerate(["the cat sat", "  the   cat ", "", None, " ", "thé 中 cat", "hence\nthe\tcats", "at " * 3000, "then the cat"]))
    got = spm.sp_encode(spark.createDataFrame(list(texts.items()), DOCS), path, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in got} == {i: sp.encode(t or "") for i, t in texts.items()}
    assert all(r.parity for r in got) and {r.doc_id for r in got if r.round_trip} >= {0, 2, 3, 8} and not next(r for r in got if r.doc_id == 1).round_trip


def test_whole_tokenizers(spark, tmp_path):
    """A tokenizer of unknown normaliser or pre-tokeniser gets whole texts: packing of any case and space is right."""
    import json

    from tokenizers import Tokenizer

    own = json.loads(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    own["normalizer"] = {"type": "Replace", "pattern": {"String": " "}, "content": "_"}
    (tmp_path / "t.json").write_text(json.dumps(own))
    texts = {1: "A Mixed Case, and spaces.", 2: "and   more 中。文", 3: None}
    for path in (str(tmp_path / "t.json"), public_tokenizers.path("byte_bpe_50k.json")):
        t = Tokenizer.from_file(path)
        got = packing.pack_documents(spark.createDataFrame(list(texts.items()), DOCS), path).collect()
        assert {r.doc_id: r.ids_crc32 for r in got} == {i: crc([*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in texts.items()}


@pytest.mark.parametrize("partitions", [4, 200, 2000])
def test_padding_at_any_partition_number(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    padded = sum(4096 - n for n in sizes.values() if n & (n - 1))
    assert padded < 0.01 * sum(sizes.values())


def test_edit_counts(spark, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    edits, after = [], {}
    for i, x in texts.items():
        x = x or ""
        own = []
        for _ in range(int(rng.integers(0, 5))):
            at, remove, new = int(rng.integers(0, len(x) + 2)), int(rng.integers(0, 12)), str(rng.choice(["", " ", "x", " new words", "\n\n", "é1", "'s", "   ", "word."]))
            own.append((at, remove, new))
            x = x[:at] + new + x[at + remove :]
        after[i] = x
        if own:
            edits.append((i, own))
    state = token_count.build_state(docs, path)
    changed = token_count.apply_edits(state, spark.createDataFrame(edits, "doc_id long, edits array<struct<at int, remove int, insert string>>"), path).collect()
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    for r in changed:
        assert r.text == after[r.doc_id] and r.n_tokens_before == count(texts[r.doc_id] or "")
        assert r.n_tokens == count(after[r.doc_id]), repr(after[r.doc_id][:100])
        for tree, total in ((r.tree_chars, len(r.text)), (r.tree_bytes, len(r.text.encode())), (r.tree_tokens, r.n_tokens)):
            assert tree[1] == total and all(tree[k] == tree[2 * k] + tree[2 * k + 1] for k in range(1, len(tree) // 2))
    long = [r for r in changed if len(r.text) > 20_000 and r.n_edits and " " in r.text[:1000]]
    assert all(r.bytes_encoded < 0.2 * len(r.text) for r in long)


def test_edits_at_the_edges(spark):
    """Starts, ends, insertions that grow a text a hundredfold, nulls, repeated ids, no rows; further batches go on from the kept trees."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    shape = "doc_id long, edits array<struct<at int, remove int, insert string>>"
    texts = [(1, "word after word stands here"), (2, None), (3, "é" * 50), (4, "gone"), (4, "gone"), (None, "kept"), (5, "stays"), (6, "z" * 70_000 + " end")]
    edits = [(1, [(0, 0, "x"), (0, 0, " y"), (10_000, 5, " tail"), (3, 2, "many words " * 900), None, (None, None, None), (-5, -5, "a")]), (2, [(0, 0, "new")]), (3, [(25, 1, " "), (0, 50, "")]), (4, [(0, 4, "")]), (None, [(0, 1, "k")]), (6, [(70_000, 1, "")]), (7, [(0, 0, "no one")]), (4, [(0, 5, "late")])]
    state = token_count.build_state(spark.createDataFrame(texts, DOCS).selectExpr("*", "'x' as edits", "1 as n_tokens"), path)
    want = {1: texts[0][1]}
    for e in edits[0][1]:
        at, remove, new = (e or (0, 0, ""))
        at, remove, new, x = max(at or 0, 0), max(remove or 0, 0), new or "", want[1]
        want[1] = x[:at] + new + x[at + remove :]
    once = token_count.apply_edits(state, spark.createDataFrame(edits, shape), path)
    again = token_count.apply_edits(once, spark.createDataFrame([(1, [(2000, 40, " mid "), (0, 3, "")])], shape), path)
    x = want[1][:2000] + " mid " + want[1][2040:]
    for rows, first in ((once.collect(), want[1]), (again.collect(), x[3:])):
        assert len(rows) == len(texts) and all(r.n_tokens == count(r.text) == r.tree_tokens[1] for r in rows)
        by = {r.doc_id: r.text for r in rows}
        assert by[1] == first and by[2] == "new" and by[None] == "kept" and by[5] == "stays" and by[6] == "z" * 70_000 + "end" and by[4] == "late"
    none = spark.createDataFrame([], DOCS)
    assert token_count.apply_edits(token_count.build_state(none, path), spark.createDataFrame(edits, shape), path).count() == 0
    assert token_count.apply_own_edits(token_count.build_state(none, path).withColumn("edits", F.expr("cast(null as array<struct<at int, remove int, insert string>>)")), path).count() == 0


def test_segment_forest():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 2, 7, 33, 5])
    forest = token_count.SegmentForest.grow({name: rng.integers(1, 9, counts.sum()) for name in token_count.SUMS}, counts)
    own = lambda d, name: forest.sums[name][forest.base[d] + forest.room[d] : forest.base[d] + 2 * forest.room[d]]
    for step in range(60):
        docs = np.flatnonzero(rng.random(6) < 0.7)
        if not len(docs):
            continue
        first = np.array([rng.integers(0, forest.room[d]) for d in docs])
        last = np.array([rng.integers(a, min(a + 3, forest.room[d])) for a, d in zip(first, docs, strict=True)])
        new = [{name: rng.integers(1, 9, k) for name in token_count.SUMS} for k in rng.integers(0, 30 if step % 9 == 0 else 5, len(docs))]
        want = {int(d): [own(d, name)[:a].sum() + n[name].sum() + own(d, name)[b + 1 :].sum() for name in token_count.SUMS] for d, a, b, n in zip(docs, first, last, new, strict=True)}
        forest.put(docs, first, last, new)
        for d, totals in want.items():
            assert [forest.total(name)[d] for name in token_count.SUMS] == totals
        back = token_count.SegmentForest.of_lists(dict(zip(token_count.SUMS, forest.lists(), strict=True)))
        for d in range(6):
            leaves = own(d, "bytes")
            ends = np.cumsum(leaves)
            for place in range(0, int(ends[-1]) + 2, 3):
                k, before = back.find(np.array([d]), np.array([place]), "bytes")
                assert k[0] == min(np.searchsorted(ends, place, side="right"), len(leaves) - 1) and before["tokens"][0] == own(d, "tokens")[: k[0]].sum()
