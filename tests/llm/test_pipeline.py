"""The pipeline's stages one by one, each against a plain version on its own input."""

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from feedlens.llm import toxicity
from tests.llm.test_pairs import near_classes
from tests.llm.test_texts import base_counts


def test_stages(spark, data, tmp_path):
    from tokenizers import Tokenizer

    documents = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "minhash", "packing"]
    steps, docs = [documents], documents
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(docs)
    for df in steps[:-1]:
        assert df.columns == documents.columns
    before, clean, good, single, packed = steps
    rows = lambda df: {r.doc_id: r.asDict() for r in df.collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = {r.doc_id for r in toxicity.score_toxicity(before, toxicity.fit(before, labels)).where("predicted = 0").collect()}
    assert rows(clean) == {i: r for i, r in rows(before).items() if i in kept}
    source = rows(clean)
    for i, r in rows(good).items():
        assert not base_counts(source[i]["text"])[5]
        assert [line for line in source[i]["text"].split("\n") if line in set(r["text"].split("\n"))] == r["text"].split("\n") and r["n_chars"] == len(r["text"])
        assert {k: v for k, v in r.items() if k not in ("text", "n_chars")} == {k: v for k, v in source[i].items() if k not in ("text", "n_chars")}
    classes = near_classes([(i, r["text"]) for i, r in rows(good).items()])
    assert rows(single) == {i: r for i, r in rows(good).items() if classes[i] == i}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for p in packed.collect():
        got.setdefault(p.doc_id, []).append(p)
    assert set(got) == set(rows(single))
    for i, r in rows(single).items():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 2], dtype="<u4")
        for p in got[i]:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids)
    assert corpus_pipeline.run(spark, data).count() == packed.count()


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeats, clashing extra columns, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, class_id string, score string, node long"
    rows = [(1, "A plain sentence with enough words to be kept, because it has more than twenty of them in all, or so we hope.", "en", "s", 5, "x", "y", 7), (1, None, None, None, None, None, None, None), (None, "x", None, None, None, None, None, None), (2, "", None, None, None, None, None, None)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    for k, part in enumerate((rows + rows[:1], [])):
        docs = spark.createDataFrame(part, schema)
        columns = docs.columns
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, f"{tmp_path}/a")
            docs.write.parquet(f"{tmp_path}/odd-{k}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/odd-{k}-{n}")
            assert n == 3 or docs.columns == columns
        assert docs.count() == (1 if part else 0)


def test_columns_of_any_name_and_type(spark, tmp_path):
    """Columns named like those that a stage makes for itself, maps and nested rows come back untouched."""
    text = lambda k: " ".join(f"Word{k}x{i} stands here." for i in range(30))
    extra = "near_row string, near_name long, row_name string, Row_Hash string, first_hash int, n_rows int, fold int, kept boolean, start string, words array<struct<a: int, b: map<string, int>>>, tags map<string, string>, `a.b` int"
    rest = lambda k: ("mine", k, "own", "hash", k, 2, 3, False, "s", [(k, {"x": k})], {"k": str(k)}, k)
    rows = [(k, text(k), *rest(k)) for k in range(6)] + [(7, text(1), *rest(7)), (None, text(8), *rest(8)), (2, text(9), *rest(9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + extra)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns, wanted = docs.columns, sorted((r for r in rows if r[0] != 7), key=lambda r: r[3])
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/any-{n}")
        docs = spark.read.parquet(f"{tmp_path}/any-{n}")
        assert docs.columns == columns
    plain = lambda r: (*r[:11], [(w[0], dict(w[1])) for w in r[11]], r[12], r[13])
    assert [plain(r) for r in sorted(docs.collect(), key=lambda r: r[3])] == [plain(r) for r in wanted]
    assert corpus_pipeline.pack(spark, docs, "").count() >= len(wanted)


def test_rows_without_own_id(spark, tmp_path):
    """Null and repeated ids: every different text stays, copies of any row go."""
    text = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    near = text(1).rsplit(" ", 1)[0]
    rows = [(1, text(1), "a"), (1, text(2), "a"), (1, text(2), "a"), (None, text(3), "a"), (None, text(4), None), (None, None, "a"), (None, near, "a"), (5, text(5), "a"), (5, None, "a"), (5, "a", None), (6, text(5), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    gone = {(None, near, "a"), (6, text(5), "b"), (5, text(5), "a")}
    assert set(rows) - gone <= set(got) and len(got) == len(set(got)) == len(set(rows)) - 2
    assert len({(5, text(5), "a"), (6, text(5), "b")} & set(got)) == 1 and (None, near, "a") not in got


def test_texts_of_one_id(spark):
    """A doc_id with two texts is linked by either of them."""
    from feedlens.llm.minhash import near_duplicates

    text = lambda k, n=60: " ".join(f"v{k}x{i}" for i in range(n))
    rows = [(9, text(k)) for k in range(12)] + [(20 + k, text(k, 59)) for k in range(12)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {9}
