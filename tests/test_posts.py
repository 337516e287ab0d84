import pytest
from pyspark.sql import functions as F

from feedlens import schemas
from feedlens.operators import posts as P

BASE = 1_782_216_800


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("今天16:00", 1782201600000), ("20分钟前", (BASE - 1200) * 1000), ("06月22日 21:49", 1782136140000), ("2025年11月03日 16:11", 1762157460000), (" 2025-11-03 16:11 ", 1762157460000), ("2025-11-03 16:11:05", 1762157465000),
        ("12月31日 00:00", 1767110400000), ("", None), (None, None), ("昨天", None), ("今天25:00", None), ("02月31日 10:00", None),
    ],
)
def test_times(spark, raw, want):
    df = spark.createDataFrame([(raw, BASE)], "raw string, seen long")
    assert df.select(P.written_at(F.col("raw"), F.col("seen"))).first()[0] == want


def hit(post, at, text, name="n", **more):
    return {"post_id": post, "url": "", "author_id": "", "author_name": "", "author_verified": False, "created_at_raw": "", "created_at_ms": None, "text": text, "pic_urls": [], "reposts_count": 0, "comments_count": 0, "attitudes_count": 0, "keyword": "k", "query_name": name, "searched_at": at, "search_rank": 1, "source_mode": "pc"} | more


HIT = schemas.POST.replace(", first_seen_at bigint, last_seen_at bigint", "") + ", keyword string, query_name string, searched_at bigint, search_rank int, source_mode string"


def test_merge_and_keywords(spark):
    empty = spark.createDataFrame([], schemas.POST)
    found = spark.createDataFrame([hit("p1", 10, "甲牌输入法 一", "b"), hit("p1", 30, "甲牌输入法 三", "a"), hit("p1", 20, "甲牌输入法 二", "b"), hit("p2", 5, "天气"), hit("", 5, "甲牌输入法"), hit("p3", 5, None), hit("p4", 7, "乙牌键盘", "")], HIT)
    first = P.merge_posts(empty, found)
    rows = {r.post_id: r for r in first.collect()}
    assert set(rows) == {"p1", "p4"} and (rows["p1"].text, rows["p1"].first_seen_at, rows["p1"].last_seen_at) == ("甲牌输入法 三", 10, 30)
    again = P.merge_posts(first, spark.createDataFrame([hit("p1", 40, "甲牌输入法 四"), hit("p4", 3, "乙牌键盘 旧")], HIT))
    rows = {r.post_id: r for r in again.collect()}
    assert (rows["p1"].text, rows["p1"].first_seen_at) == ("甲牌输入法 四", 10) and (rows["p4"].text, rows["p4"].first_seen_at) == ("乙牌键盘", 3)
    assert P.merge_posts(empty, found, skip_irrelevant=False).count() == 4
    words = {r.post_id: r.keywords for r in P.keywords_of(P.new_hits(found)).collect()}
    assert words["p1"] == ["b", "a"] and words["p4"] == ["k"]


def test_labels(spark):
    texts = ["甲牌输入法难用", "乙牌手机好用，不如甲牌的键盘准确", "乙牌很甜", None, "求助：广告弹窗泄露", "好用但是卡", "推荐 BUG"]
    rows = P.with_post_label(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r.brand_focus for r in rows] == ["own", "comparison", "other", "other", "other", "other", "other"]
    assert [r.sentiment for r in rows] == ["negative", "positive", "neutral", "neutral", "negative", "mixed", "mixed"]
    assert rows[1].topics == ["input_experience", "feature_comparison"] and rows[3].topics == ["other"] and rows[6].topics == ["bug"]
    assert [r.post_type for r in rows] == ["complaint", "other", "other", "other", "help", "other", "recommendation"]
    assert [r.risk_level for r in rows] == ["normal", "normal", "normal", "normal", "high", "normal", "normal"]


def test_lists(spark):
    found = spark.createDataFrame([hit(f"p{i}", 1000 * i, f"甲牌输入法 {i} 泄露", created_at_ms=500 if i == 3 else None) for i in range(1, 5)], HIT)
    posts = P.merge_posts(spark.createDataFrame([], schemas.POST), found)
    labels = P.classify_posts(posts).withColumn("label_source", F.when(F.col("post_id") == "p4", P.HIDDEN).otherwise(F.col("label_source")))
    hits = P.new_hits(found)
    get = lambda **k: [r.post_id for r in P.list_posts(posts, labels, hits, **k).orderBy(F.desc("event_ms")).collect()]
    assert get() == ["p2", "p1", "p3"] and get(include_hidden=True) == ["p4", "p2", "p1", "p3"] and get(limit=1, offset=1) == ["p1"]
    assert get(keyword="n", risk_level="high", q="2") == ["p2"] and get(keyword="zz") == [] and get(topic="privacy", brand_focus="rival") == []
    for bad in ({"topic": "x"}, {"risk_level": "x"}, {"limit": 0}):
        with pytest.raises(ValueError):
            get(**bad)
    assert [r.post_id for r in P.to_label(posts, labels).collect()] == ["p2", "p1", "p3"]


def test_replies(spark):
    ok = '{"is_relevant": "Yes", "brand_focus": "own", "sentiment": "mixed", "topics": "ads", "post_type": "help", "risk_level": "high", "summary": "s", "reason": "r", "confidence": "3"}'
    rows = [("1", ok), ("2", ok.replace('"Yes"', "false").replace('"3"', '""')), ("3", ok.replace("mixed", "odd")), ("4", None), ("5", "[1]"), ("6", ok.replace('"3"', '"x"')), ("7", ok.replace('"Yes"', '"maybe"'))]
    df = spark.createDataFrame(rows, "post_id string, reply string")
    good, bad = P.reply_labels(df)
    got = {r.post_id: r for r in good.collect()}
    assert (got["1"].topics, got["1"].confidence, got["1"].reason, got["1"].label_source) == (["ads"], 1.0, "s\n\nr", "llm") and got["2"].label_source == P.HIDDEN and got["2"].confidence is None
    assert {r.post_id: r.problem for r in bad.collect()} == {"3": "sentiment", "4": "json", "5": "json", "6": "confidence", "7": "is_relevant"}
    assert P.reply_counts(df).first().asDict() == {"seen": 7, "labeled": 2, "hidden": 1, "failed": 5}


def test_a_reply_is_parsed_once(spark):
    df = spark.createDataFrame([("1", "{}")], "post_id string, reply string")
    for out in (P.reply_labels(df)[0], P.reply_counts(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 2  # the reply, and its list of topics


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    from feedlens.adapters import post_hits
    from feedlens.session import dealt

    spark.range(4000).coalesce(1).selectExpr("id AS event_id", "id % 9 AS user_id", "'view' AS event_type", "1.0D AS value", "timestamp_seconds(1704067200 + id) AS ts", "'{\"k\": 1}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for df in (dealt(spark.read.parquet(f"{tmp_path}/events.parquet")), post_hits(spark, str(tmp_path))):
            assert max(map(len, df.rdd.glom().collect())) < 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("raw", ["2025年13月03日 16:11", "0000年01月03日 16:11", "02月31日 10:00", "今天25:00", "2025年11月03日 16:60"])
def test_no_time(spark, raw):
    df = spark.createDataFrame([(raw, 1750000000)], "raw string, seen long")
    assert df.select(P.written_at(F.col("raw"), F.col("seen"))).first()[0] is None
