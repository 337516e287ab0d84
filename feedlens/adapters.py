"""The test tables in the roles of the domain's: events as messages and posts, conversations as chats.

The texts of messages and posts are fixed lists of sentences, one for each
event by its number, so that every rule has cases.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import schemas
from feedlens.operators import posts as P
from feedlens.operators.sessionize import sessionize_all
from feedlens.session import dealt, shared_root
from feedlens.sources.poststore import PostStore
from feedlens.sources.store import LabelStore
from feedlens.sources.textindex import blocks_of, grams_of

#: Sessions of messages in most queries, so that conversations have several messages.
LONG_GAP_MS = 43_200_000
#: The newest time of the events table, the "now" of look-back queries.
NOW_MS = 1_706_659_200_000

PHRASES = (
    "打字的时候突然闪退", "键盘总是卡顿", "希望增加新的皮肤", "怎么登录账号？", "好用", "垃圾", "哈哈哈", "😀😀", "   ", "a",
    "语音输入一直用不了", "升级以后乱码", "候选词错位了", "建议支持双拼", "请问词库在哪里同步", "手机发烫还耗电", "每次打开都白屏", "最好以后能换主题", "为什么没有手写", "123",
    "今天天气很好", "我在看书", "emoji 表情找不到", "Crash after update", "bug 很多", "频繁自动退出，延迟也大", "广告弹窗太多了", "隐私权限怎么设置", "反应慢", "输入法无法输入文字",
    "这个键盘的高度不对，麦克风权限也打不开，语音识别不准，反馈了三次都没有人回复", "测试", "！！！", "很好用的输入法推荐给大家了", "云同步丢失了短语", "求加悬浮窗", "咋关闭震动", "剪贴板内容消失了", "为啥联想不准", "顶",
)
POST_TEXTS = (
    "甲牌输入法真好用，推荐大家试试", "甲牌的键盘太卡了，崩了好几次", "乙牌输入法的语音输入不如甲牌输入法准确", "乙牌的AI手机很智能", "今天吃什么", "甲牌输入法怎么关闭广告弹窗？求助",
    "乙牌键盘体验评测：流畅但是偷听隐私", "转发：甲牌输入法新闻发布会上线新功能", "甲牌键盘泄露数据上热搜，严重！", "换成乙牌输入法了，口碑不错", "甲牌今天开会", "乙牌很甜",
)
PLATFORMS = ("iOS", "Android", "Win", "Mac", "小程序")
DEVICES = ("iPhone15,2", "Pixel 8", "ThinkPad X1", "MacBookPro18,3", "")
RAW_TIMES = ("今天16:00", "20分钟前", "06月22日 21:49", "2025年11月03日 16:11", "2024-01-05 08:30", "", "昨天", "01月31日 09:05", "2024-01-05 08:30:15")
QUERY_NAMES = ("甲牌", "乙牌", "对比")
REPLIES = (
    '```json\n{"L1": "A.Bug", "L2": ["性能", "不存在"], "severity": "P1", "confidence": 1.4, "reason": "卡"}\n```', '{"L1": "X", "L2": [], "severity": "P9", "confidence": "0.5", "reason": ""}', "没有", "```\n{\"L1\": \"C.咨询\", \"confidence\": 0.25}\n```",
    '好的：{"L1": "B.建议", "L2": ["皮肤"], "severity": "P3", "confidence": -2, "reason": " 想要皮肤 "}', '{"L1": broken', None,
)
POST_REPLIES = (
    '```json\n{"is_relevant": true, "brand_focus": "own", "sentiment": "negative", "topics": ["bug", "bug", "x"], "post_type": "complaint", "risk_level": "watch", "summary": "卡", "reason": "崩溃", "confidence": 0.9}\n```',
    '{"is_relevant": "no", "brand_focus": "other", "sentiment": "neutral", "topics": [], "post_type": "other", "risk_level": "normal", "relevance_reason": "无关", "confidence": 2}',
    '{"is_relevant": true, "brand_focus": "nobody", "sentiment": "neutral", "topics": [], "post_type": "other", "risk_level": "normal"}', "不是 JSON", '{"is_relevant": 3, "brand_focus": "own", "sentiment": "mixed", "topics": ["ads"], "post_type": "help", "risk_level": "high"}',
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple, at: Column) -> Column:
    """The value at a place that counts from 0, modulo their number."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, ts_ms and k, the number in props."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.get_json_object("props", "$.k").cast("int").alias("k"), "props")


def messages(spark: SparkSession, sf_dir: str, *, kind: bool = False) -> DataFrame:
    """Every event as a message of the feedback schema, sessions not yet found; with ``kind`` its event_type beside it. Some have no user."""
    e = events(spark, sf_dir)
    version = F.when(F.col("k") % 7 == 6, "").otherwise(F.concat_ws(".", (F.col("k") % 3 + 3).cast("string"), (F.col("k") % 4).cast("string"), (F.col("k") % 5).cast("string")))
    return schemas.conform(e.select(
        F.concat(F.lit("e"), "event_id").alias("feedback_id"), F.lit("pending").alias("conversation_id"), F.lit(0).alias("msg_seq"), F.lit("app").alias("channel"), "ts_ms",
        pick(PLATFORMS, F.col("user_id")).alias("platform"), version.alias("appversion"), F.when(F.col("user_id") % 29 != 3, F.concat(F.lit("u"), "user_id")).alias("user_vid"),
        F.when(F.col("k") % 11 != 0, F.lit(10000)).alias("service_vid"), pick(DEVICES, F.col("user_id")).alias("device_name"), F.lit("text").alias("msgtype"),
        pick(PHRASES, F.col("event_id")).alias("text"), F.lit("").alias("tags"), F.concat(F.lit('{"service_vid": '), (F.col("k") + 20000).cast("string"), F.lit("}")).alias("raw_json"), F.lit(0).alias("pulled_at"), "event_type",
    ), schemas.FEEDBACK + (", event_type string" if kind else ""))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a nested response of one session with three messages: the user's, an agent's, an image."""
    e = events(spark, sf_dir)
    info = F.struct(
        pick((1, 2, 7, 9, 11, 5), F.col("k")).alias("platform"), F.lit(0).alias("os"), F.concat_ws(".", F.lit("5"), (F.col("k") % 4).cast("string")).alias("appversion"),
        pick(("iPhone 15", "android-14", "Windows 11", "Mac OS X", "", "fridge"), F.col("event_id")).alias("device"), pick(DEVICES, F.col("user_id")).alias("deviceName"), F.lit("").alias("channelid"), F.lit("").alias("enginever"), F.lit("").alias("keyboardSource"),
    )
    user = F.when(F.col("user_id") % 29 != 3, F.concat(F.lit("u"), "user_id"))
    message = lambda sender, kind, shift, ident: F.struct(
        F.lit(sender).alias("sender"), F.lit(kind).alias("type"), (F.col("ts_ms") + shift).alias("timestamp"), ident.alias("feedbackId"), F.lit(None).cast("string").alias("replyId"),
        F.struct(F.concat(F.lit("  "), pick(PHRASES, F.col("event_id")), F.lit(" \n")).alias("text"), F.lit("").alias("url"), F.lit("").alias("scheme")).alias("content"), info.alias("clientInfo"),
        F.struct(user.alias("userVid")).alias("user"), F.array(F.lit("x"), F.lit(""), F.col("event_type")).alias("tags"),
    )
    own = F.when(F.col("k") % 13 != 0, F.concat(F.lit("e"), "event_id"))
    msgs = F.array(message(0, "text", 0, own), message(1, "text", 1000, F.concat(F.lit("a"), "event_id")), message(0, "image", 2000, F.concat(F.lit("i"), "event_id")))
    session = F.struct(F.concat(F.lit("s"), "user_id").alias("userVid"), F.lit("app").alias("channel"), F.when(F.col("k") % 11 != 0, F.col("k").cast("long")).alias("serviceVid"))
    return e.select(F.lit(0).alias("errCode"), F.array(F.struct(session.alias("session"), msgs.alias("msgs"))).alias("results"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionize_all(messages(spark, sf_dir), gap_ms=LONG_GAP_MS)


_STORES: dict[tuple, LabelStore] = {}


def _state(spark: SparkSession, sf_dir: str, name: str) -> tuple:
    """Names, sizes and times of a table's files, which tell whether it has changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def store(spark: SparkSession, sf_dir: str) -> LabelStore:
    """The labelled messages and conversations of a folder, stored once in each session and for each state of its events."""
    key = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir, "events")
    if key not in _STORES:
        _STORES[key] = LabelStore(f"{shared_root(spark)}/labels-{uuid.uuid4().hex}", buckets=8, gap_ms=LONG_GAP_MS).create(messages(spark, sf_dir))
    return _STORES[key]


_INDEXES: dict[tuple, tuple[str, str]] = {}


def document_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts of the documents in blocks and the blocks' grams, stored once in each session and for each state of the table."""
    key = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir, "documents")
    if key not in _INDEXES:
        paths = tuple(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}" for name in ("texts", "grams"))
        blocks_of(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text"), block_rows=16).write.parquet(paths[0])
        grams_of(spark.read.parquet(paths[0])).sort("gram").write.parquet(paths[1])
        _INDEXES[key] = paths
    return tuple(map(spark.read.parquet, _INDEXES[key]))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).conversations(spark)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations table as messages with their conversation already known: (conversation_id, msg_seq, role, text)."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("msg_seq"), "role", "text")


def post_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits of posts; three neighbouring events are hits of one post. The scan is dealt over all cores before times are parsed."""
    e = dealt(events(spark, sf_dir))
    post = F.floor(F.col("event_id") / 3).cast("long")
    return e.select(
        F.concat(F.lit("p"), post.cast("string")).alias("post_id"), F.concat(F.lit("https://posts.example/"), post.cast("string")).alias("url"), F.col("user_id").cast("string").alias("author_id"), F.lit("").alias("author_name"),
        (F.col("k") % 2 == 0).alias("author_verified"), pick(RAW_TIMES, post).alias("created_at_raw"), P.written_at(pick(RAW_TIMES, post), F.floor(F.col("ts_ms") / 1000)).alias("created_at_ms"),
        pick(POST_TEXTS, post).alias("text"), F.array().cast("array<string>").alias("pic_urls"), F.col("k").alias("reposts_count"), F.lit(0).alias("comments_count"), F.lit(0).alias("attitudes_count"),
        F.concat(F.lit("q"), (F.col("event_id") % 3).cast("string")).alias("keyword"), pick(QUERY_NAMES, F.col("k")).alias("query_name"), F.floor(F.col("ts_ms") / 1000).alias("searched_at"), (F.col("event_id") % 20 + 1).cast("int").alias("search_rank"), F.lit("pc").alias("source_mode"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts after all hits are merged into an empty table."""
    return P.merge_posts(spark.createDataFrame([], schemas.POST), post_hits(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as crawl runs."""
    return events(spark, sf_dir).where("event_type = 'purchase'").select(F.concat(F.lit("r"), "event_id").alias("run_id"), (F.col("ts_ms") * 1000 + F.col("event_id") % 1000).alias("started_at"), F.col("k").cast("long").alias("posts_found"))


_POSTS: dict[tuple, PostStore] = {}


def post_store(spark: SparkSession, sf_dir: str) -> PostStore:
    """Posts, labels and hits after all hits, stored once in each session and for each state of the events."""
    key = spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir, "events")
    if key not in _POSTS:
        _POSTS[key] = PostStore(f"{shared_root(spark)}/posts-{uuid.uuid4().hex}").take(post_hits(spark, sf_dir))
    return _POSTS[key]
