"""Conversations: messages of a user without a gap longer than the limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlens.config import DAY_MS, GAP_MS

#: Messages of one user that a task may hold.
BUSY = 1_000_000


def user_key(user: Column, message: Column) -> Column:
    """The user, or a key of its own for a message without one."""
    return F.when(user.isNull() | (user == ""), F.concat(F.lit("anon_"), F.substring(F.sha1(F.concat(F.lit("anon:"), message).cast("binary")), 1, 12))).otherwise(user)


def conversation_id(key: Column, first_ts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", key, first_ts.cast("string")).cast("binary")), 1, 12)


def sessionize(messages: DataFrame, *, gap_ms: int = GAP_MS) -> DataFrame:
    """Adds conversation_id and msg_seq (from 0) to (feedback_id, user_vid, ts_ms, ...).

    A message starts a conversation if it is its user's first or comes more than
    ``gap_ms`` after the one before, in the order of (ts_ms, feedback_id). All
    windows share one partitioning: a single exchange by user.
    """
    m = messages.withColumn("_key", user_key(F.col("user_vid"), F.col("feedback_id")))
    by_user = Window.partitionBy("_key").orderBy("ts_ms", "feedback_id")
    before = F.lag("ts_ms").over(by_user)
    starts = m.withColumn("_new", F.when(before.isNull() | (F.col("ts_ms") - before > gap_ms), F.col("ts_ms")))
    known = starts.withColumn("_first", F.last("_new", ignorenulls=True).over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    seq = F.row_number().over(Window.partitionBy("_key", "_first").orderBy("ts_ms", "feedback_id")) - 1
    out = known.withColumns({"conversation_id": conversation_id(F.col("_key"), F.col("_first")), "msg_seq": seq})
    return out.drop("_key", "_new", "_first")


def sessionize_split(messages: DataFrame, *, gap_ms: int = GAP_MS, span_ms: int = DAY_MS) -> DataFrame:
    """The result of ``sessionize`` without bringing all messages of a user together.

    Windows run inside a user's spans of time. What crosses their borders - the
    last message before, the open conversation's start and its length so far - is
    carried by a table of one row for each user and span. For users so busy that
    one task can't hold their history.
    """
    m = messages.withColumns({"_key": user_key(F.col("user_vid"), F.col("feedback_id")), "_span": F.floor(F.col("ts_ms") / span_ms)})
    spans = m.groupBy("_key", "_span").agg(F.max("ts_ms").alias("_last"))
    along = Window.partitionBy("_key").orderBy("_span")
    spans = spans.select("_key", "_span", F.lag("_last").over(along).alias("_before"))
    inside = Window.partitionBy("_key", "_span").orderBy("ts_ms", "feedback_id")
    m = m.join(spans, ["_key", "_span"])
    before = F.coalesce(F.lag("ts_ms").over(inside), F.col("_before"))
    m = m.withColumns({"_new": F.when(before.isNull() | (F.col("ts_ms") - before > gap_ms), F.col("ts_ms")), "_place": F.row_number().over(inside)})
    m = m.withColumn("_first", F.last("_new", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("_start_place", F.last(F.when(F.col("_new").isNotNull(), F.col("_place")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    tail = m.groupBy("_key", "_span").agg(F.count("*").alias("_rows"), F.max("_new").alias("_new"), F.max(F.when(F.col("_new").isNotNull(), F.col("_place"))).alias("_place"))
    before_rows = along.rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("_upto", F.coalesce(F.sum("_rows").over(before_rows), F.lit(0)))
    carry = tail.select(
        "_key", "_span", F.last("_new", ignorenulls=True).over(before_rows).alias("_carried"),
        (F.col("_upto") - F.last(F.col("_upto") + F.col("_place"), ignorenulls=True).over(before_rows) + 1).alias("_length"),
    )
    m = m.join(carry, ["_key", "_span"])
    first = F.coalesce("_first", "_carried")
    seq = F.when(F.col("_first").isNotNull(), F.col("_place") - F.col("_start_place")).otherwise(F.col("_length") + F.col("_place") - 1)
    out = m.withColumns({"conversation_id": conversation_id(F.col("_key"), first), "msg_seq": seq.cast("int")})
    return out.drop("_key", "_span", "_before", "_new", "_place", "_first", "_start_place", "_carried", "_length")


def sessionize_all(messages: DataFrame, *, gap_ms: int = GAP_MS, busy: int = BUSY) -> DataFrame:
    """The result of ``sessionize`` for any users: those of more than ``busy`` messages go by spans of time, the others whole.

    Users are counted first, combined before the exchange; where none is busy the plan is the plain one.
    """
    per_user = messages.where(F.coalesce("user_vid", F.lit("")) != "").groupBy(F.col("user_vid").alias("_u")).agg(F.count("*").alias("_n"))
    crowd = per_user.where(F.col("_n") > busy).select("_u")
    if crowd.isEmpty():
        return sessionize(messages, gap_ms=gap_ms)
    on = messages.user_vid == crowd._u
    few, many = (messages.join(crowd, on, how) for how in ("left_anti", "left_semi"))
    return sessionize(few, gap_ms=gap_ms).unionByName(sessionize_split(many, gap_ms=gap_ms))


def conversation_spans(sessions: DataFrame) -> DataFrame:
    """(conversation_id, user_vid, msg_count, first_ts_ms, last_ts_ms)."""
    return sessions.groupBy("conversation_id").agg(
        F.min("user_vid").alias("user_vid"), F.count("*").alias("msg_count"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms")
    )
