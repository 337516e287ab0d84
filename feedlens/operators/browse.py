"""Lists, details, distributions and trends of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens.functions import text as T
from feedlens.operators.filters import Filters, check_page, narrow

PREVIEW_CHARS = 80


def page(conversations: DataFrame, messages: DataFrame, *, limit: int = 50, offset: int = 0, most: int = 500, url_base: str = "chat") -> DataFrame:
    """One page of conversations, newest first, equal times by id, with the preview and platform of message 0.

    Stored conversations hold both, so the messages aren't read. Without them the
    page is cut first; its ids, ``most`` at the outside, are broadcast to pick the
    few messages that are shown, so the messages aren't shuffled.
    """
    check_page(limit, offset, most=most)
    rows = conversations.orderBy(F.desc("last_ts_ms"), "conversation_id").offset(offset).limit(limit)
    out = rows
    if "preview_text" not in rows.columns:
        shown = messages.where("msg_seq = 0").join(F.broadcast(rows.select("conversation_id")), "conversation_id", "left_semi")
        first = shown.select("conversation_id", F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW_CHARS).alias("preview_text"), F.coalesce("platform", F.lit("")).alias("platform"))
        out = rows.join(first, "conversation_id", "left")
    service = F.coalesce("service_vid", F.lit(C.DEFAULT_SERVICE_VID))
    url = F.coalesce(F.nullif(F.col("external_chat_url"), F.lit("")), T.chat_url(url_base, F.col("channel"), service, F.col("user_vid")))
    return out.select(
        "conversation_id", "L1", "L2", "severity", "confidence", "reason", "msg_count", "first_ts_ms", "last_ts_ms", "user_vid", "appversion", "channel",
        service.alias("service_vid"), url.alias("external_chat_url"), F.coalesce("platform", F.lit("")).alias("platform"), F.coalesce("preview_text", F.lit("")).alias("preview_text"),
    )


def list_conversations(conversations: DataFrame, messages: DataFrame, f: Filters = Filters(), **paging: int) -> DataFrame:
    return page(narrow(conversations, messages, f), messages, **paging)


def detail(conversation_id: str, messages: DataFrame, labels: DataFrame) -> DataFrame:
    """Messages of one conversation with their labels, where there are any, in order."""
    mine = messages.where(F.col("conversation_id") == conversation_id)
    columns = ["L1", "L2", "severity", "confidence", "reason", "source", "rule_name"]
    return mine.join(labels.select("feedback_id", *columns), "feedback_id", "left").select("feedback_id", "msg_seq", "ts_ms", "text", "appversion", "platform", *columns).orderBy("msg_seq")


def distribution(conversations: DataFrame) -> DataFrame:
    """(dim, value, n) for L1, severity and each tag, from one scan; a conversation of n tags counts n times under L2."""
    one = lambda dim, c: F.array(F.struct(F.lit(dim).alias("dim"), F.col(c).alias("value")))
    tags = F.transform(F.coalesce(T.split_list(F.col("L2")), F.array().cast("array<string>")), lambda t: F.struct(F.lit("L2").alias("dim"), t.alias("value")))
    return conversations.select(F.explode(F.concat(one("L1", "L1"), one("severity", "severity"), tags)).alias("e")).groupBy("e.dim", "e.value").agg(F.count("*").alias("n"))


def trend(conversations: DataFrame, granularity: str = "day") -> DataFrame:
    """(bucket, L1, n); buckets without conversations have no row."""
    return conversations.groupBy(T.time_bucket(F.col("last_ts_ms"), granularity).alias("bucket"), "L1").agg(F.count("*").alias("n"))


def dense_trend(conversations: DataFrame, granularity: str = "day") -> DataFrame:
    """One row per bucket and one column per L1, 0 where there is none."""
    counts = [F.count_if(F.col("L1") == v).alias(v) for v in C.L1_VALUES]
    return conversations.groupBy(T.time_bucket(F.col("last_ts_ms"), granularity).alias("bucket")).agg(*counts)


def rates(conversations: DataFrame) -> DataFrame:
    """One row: total, p0, and the shares that are classified by rule and pending, as text with one decimal."""
    n = F.count("*")
    share = lambda c: T.percent(F.count_if(c), n)
    return conversations.agg(n.alias("total"), F.count_if(F.col("severity") == "P0").alias("p0"), share(F.col("L1") != "待定").alias("classified"), share(F.col("L1") == "待定").alias("pending"))


def top_tags(conversations: DataFrame, n: int = 10) -> DataFrame:
    return distribution(conversations).where("dim = 'L2'").select(F.col("value").alias("tag"), "n").orderBy(F.desc("n"), "tag").limit(n)


def by_score(items: DataFrame, score: Column | str = "score", *, limit: int | None = None) -> DataFrame:
    """Sorted by relevance score, a missing one as 0, newest first among equals; all of them, or the first ``limit``."""
    rows = items.orderBy(F.coalesce(score, F.lit(0)).desc(), F.desc("last_ts_ms"), "conversation_id")
    return rows if limit is None else rows.limit(limit)


def messages_per_conversation(messages: DataFrame) -> DataFrame:
    """One row: messages, conversations and their ratio (null without conversations)."""
    per = messages.groupBy("conversation_id").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("*").alias("conversations")).withColumn("ratio", F.try_divide("messages", "conversations"))
