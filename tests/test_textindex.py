"""The substring index against a scan: nothing is lost, blocks are skipped, and it follows the store's versions."""

import random

import pytest

from feedlens import schemas
from feedlens.operators.search import KeywordGroup, keyword_condition, keyword_search
from feedlens.sources import textindex as TI
from feedlens.sources.store import LabelStore

ODD = [None, "", "a", "é", "😀😀b", "ÄA", "line\nbreak", "tab\tx", "[regex].*", "\\E\\Q", "%_", "Straße", "ıI", "x" * 5000]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeÉé闪退键盘") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(3000)] + [(10_000 + i, t) for i, t in enumerate(ODD * 3)] + [(20_000 + i, "one of many equal texts") for i in range(1500)]
    return spark.createDataFrame(rows, "id long, text string")


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    path = tmp_path_factory.mktemp("index")
    TI.blocks_of(texts, block_rows=32).write.parquet(f"{path}/texts")
    TI.grams_of(spark.read.parquet(f"{path}/texts")).write.parquet(f"{path}/grams")
    return spark.read.parquet(f"{path}/texts"), spark.read.parquet(f"{path}/grams")


G = KeywordGroup
SEARCHES = [
    [G(["闪退"])], [G(["CD", "é"])], [G(["a"], "OR"), G(["键盘", "ab"])], [G(["zz9"])], [G([""])], [G(["", "zz9"])], [G(["😀b"])], [G(["\\E"])], [G(["[regex].*", "equal TEXTS"], "OR")], [G([]), G(["straSSE", "straße"], "OR")],
    [G(["e\nb"])], [G(["%_"])], [G(["abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-äöüß闪退键盘输入法语音麦克风"]), G(["一二三四五六七八九十" * 5, "tab\tX"], "OR")],
]


@pytest.mark.parametrize("groups", SEARCHES, ids=range(len(SEARCHES)))
@pytest.mark.parametrize("most", [4096, 2])
def test_equals_a_scan(texts, stored, groups, most):
    want = sorted(r.id for r in texts.where(keyword_condition(groups)).collect())
    got = sorted(r.id for r in TI.search_texts(*stored, groups, most_listed=most).collect())
    assert got == want


def test_blocks_are_skipped(stored):
    assert TI.skipped_share(*stored, [G(["regex"])]) > 0.9 and TI.skipped_share(*stored, [G(["zz9"])]) == 1 and TI.skipped_share(*stored, [G([""])]) == 0
    with pytest.raises(ValueError):
        TI.gram_condition([G([])])


def test_a_rare_word_of_the_documents(spark, data):
    """Of the documents' blocks most are left out for a word of a few texts."""
    from feedlens import adapters as A

    texts, grams = A.document_index(spark, data)
    word = sorted(w for r in texts.limit(3).collect() for w in (r.text or "").split() if len(w) > 9)[0]
    assert TI.skipped_share(texts, grams, [G([word])]) > 0.5
    assert TI.search_texts(texts, grams, [G([word])]).count() == spark.read.parquet(f"{data}/documents.parquet").where(keyword_condition([G([word])])).count()


def test_index_of_the_store(spark, tmp_path):
    rows = [(f"m{k}", f"u{k % 30}", 10_000_000 * k, ("闪退了", "很好用", "Crash again", "键盘卡顿", "天气")[k % 5] + (f" rare{k}" if k % 40 == 0 else "")) for k in range(200)]
    full = schemas.conform(spark.createDataFrame(rows, "feedback_id string, user_vid string, ts_ms long, text string"), schemas.FEEDBACK)
    store = LabelStore(str(tmp_path), buckets=4).create(full.where("ts_ms < 1500000000")).add_index(spark).add_index(spark)
    assert store.log(spark).latest() == 2
    before = {r.conversation_id for r in store.keyword_search(spark, [G(["RARE120"])]).collect()}
    store.refresh(full.where("ts_ms >= 1400000000"))
    scan = lambda *a: {r.conversation_id for r in keyword_search(store.conversations(spark), store.messages(spark), *a).collect()}
    for groups, excludes in (([G(["crash"])], []), ([G(["键盘", "rare"]), G(["闪退"])], ["again", "9"]), ([G(["rare160"])], []), ([G(["nothing"])], [])):
        assert {r.conversation_id for r in store.keyword_search(spark, groups, excludes).collect()} == scan(groups, excludes)
    assert before == {r.conversation_id for r in store.keyword_search(spark, [G(["rare120"])], version=2).collect()} and len(before) == 1


def test_equal_texts_of_a_block_give_their_grams_once(stored):
    """Repeated texts are brought together before they are taken apart, and leave the same grams."""
    texts, grams = stored
    own = TI.grams_of(texts, repeated=True)
    assert sorted(map(tuple, own.select("block", "gram").collect())) == sorted(map(tuple, grams.select("block", "gram").collect()))
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Generate")  # below the explode


def test_grams_of_odd_texts(spark):
    """A text is searched for half of its pairs at a time and split into characters, without a look ahead at each place, and loses none."""
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate([*ODD, "\n", "\n\n", "😀", "A", *("".join(rng.choice("aBÉ闪😀\n ") for _ in range(n)) for n in range(1, 60))])]
    grams = TI.grams_of(spark.createDataFrame(rows, "block long, text string"))
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    want = sorted({(i, g) for i, t in rows for s in (fold(t),) for g in [*s, *(s[k : k + 2] for k in range(len(s) - 1))]})
    assert sorted((r.block, r.gram) for r in grams.collect()) == want
    plan = grams._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and "(?=" not in plan
    broken = spark.sql("SELECT 1L AS block, CAST(unhex('F061C3F09F986262') AS STRING) AS text")
    assert {"a", "b", "bb"} <= {r.gram for r in TI.grams_of(broken).collect()}
