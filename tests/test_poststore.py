"""Stored posts against posts merged and classified whole: parts, repeats, model labels, buckets left alone."""

import pytest

from feedlens import schemas
from feedlens.operators import posts as P
from feedlens.sources.poststore import HIT, PostStore

TEXTS = ("甲牌输入法真好用，推荐大家试试", "甲牌的键盘太卡了，崩了好几次", "今天吃什么", "乙牌输入法的语音输入不如甲牌输入法准确", None)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [(f"p{k % 12}" if k % 31 else "", TEXTS[k % 5], k % 3, 1_700_000_000 + 60 * k, f"q{k % 2}", "" if k % 4 else "对比", k % 9) for k in range(120)]
    df = spark.createDataFrame(rows, "post_id string, text string, reposts_count int, searched_at long, keyword string, query_name string, search_rank int")
    full = schemas.conform(df, schemas.POST)
    return full.drop("first_seen_at", "last_seen_at").join(df.select("post_id", "text", "searched_at", "keyword", "query_name", "search_rank"), ["post_id", "text"]).selectExpr("*", "'pc' as source_mode").where("false").unionByName(
        df.selectExpr("*", "'u' as url", "'a' as author_id", "'n' as author_name", "true as author_verified", "'' as created_at_raw", "cast(null as long) as created_at_ms", "cast(array() as array<string>) as pic_urls", "0 as comments_count", "0 as attitudes_count", "'pc' as source_mode")
    )


def shown(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_parts_give_the_whole(spark, hits, tmp_path):
    store = PostStore(str(tmp_path), buckets=4)
    assert all(store.table(spark, t).count() == 0 for t in ("posts", "labels", "hits"))
    for low, high in ((40, 90), (0, 40), (90, 120), (30, 60)):  # also late, and partly known
        store.take(hits.where(f"searched_at >= {1_700_000_000 + 60 * low} and searched_at < {1_700_000_000 + 60 * high}"))
    posts = P.merge_posts(spark.createDataFrame([], schemas.POST), hits)
    assert shown(store.table(spark, "posts")) == shown(posts)
    assert shown(store.table(spark, "labels")) == shown(P.classify_posts(posts))
    assert shown(store.table(spark, "hits")) == shown(P.new_hits(hits.where(P.relevant("text") & (hits.post_id != ""))).select(*HIT))
    before = store.log(spark).latest()
    store.take(hits.limit(0))
    assert store.log(spark).latest() == before


def test_model_labels_and_new_hits(spark, hits, tmp_path):
    store = PostStore(str(tmp_path), buckets=4).take(hits)
    good = '{"is_relevant": false, "brand_focus": "own", "sentiment": "neutral", "topics": [], "post_type": "other", "risk_level": "normal"}'
    replies = spark.createDataFrame([("p0", good), ("p1", "no"), ("unknown", good)], "post_id string, reply string")
    one = store.log(spark).version()
    assert [r.post_id for r in store.apply_replies(replies, labeled_at=5).collect()] == ["p1"]
    labels = {r.post_id: r.label_source for r in store.table(spark, "labels").collect()}
    assert labels["p0"] == P.HIDDEN and "unknown" not in labels and set(labels.values()) == {"rule", P.HIDDEN}
    two = store.log(spark).version()
    assert {f.file for f in one.files if f.table != "labels"} <= {f.file for f in two.files}
    again = hits.where("post_id = 'p0'")
    store.take(again.withColumn("searched_at", again.searched_at + 10_000))  # found again: the rule's label, as for any post that comes in
    assert {r.post_id: r.label_source for r in store.table(spark, "labels").collect()}["p0"] == "rule"
    assert {r.post_id: r.label_source for r in store.table(spark, "labels", two.number).collect()}["p0"] == P.HIDDEN
