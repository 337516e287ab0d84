"""Reading messages: nested responses, stored tables, incremental and daily scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import schemas
from feedlens.config import DAY_MS, DEFAULT_SERVICE_VID
from feedlens.functions import text as T
from feedlens.sources.windows import day_range


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON responses, one a line, with a fixed schema (no inference pass)."""
    return spark.read.schema(schemas.RAW_RESPONSE).json(path)


def _messages(responses: DataFrame) -> DataFrame:
    sessions = responses.select(F.explode("results").alias("s"))
    return sessions.select("s.session", F.explode("s.msgs").alias("m"))


def _wanted(start_ms: int, end_ms: int) -> tuple[Column, Column]:
    mine = (F.col("m.sender") == 0) & (F.col("m.type") == "text")
    return mine, F.coalesce("m.timestamp", F.lit(0)).between(start_ms, end_ms)


def flatten_responses(responses: DataFrame, *, start_ms: int, end_ms: int, channel: str, url_base: str = "chat", pulled_at: int = 0) -> DataFrame:
    """Feedback rows of the users' own text messages inside the window, both ends included.

    Messages without an id are dropped. conversation_id is still pending; sessions
    are found later.
    """
    mine, inside = _wanted(start_ms, end_ms)
    m, session = "m", "session"
    service = F.coalesce(F.nullif(F.col(f"{session}.serviceVid"), F.lit(0)), F.lit(DEFAULT_SERVICE_VID)).cast("long")
    user = F.coalesce(F.nullif(F.col(f"{m}.user.userVid"), F.lit("")), F.col(f"{session}.userVid"))
    info = lambda c: F.coalesce(F.col(f"{m}.clientInfo.{c}"), F.lit("")).alias({"deviceName": "device_name", "keyboardSource": "keyboard_source"}.get(c, c))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.to_json(F.struct(
        empty(f"{m}.content.url").alias("url"), empty(f"{m}.content.scheme").alias("scheme"), empty(f"{m}.clientInfo.device").alias("device"),
        F.col(f"{m}.clientInfo.platform").alias("raw_platform_code"), F.col(f"{m}.clientInfo.os").alias("raw_os_code"),
        empty(f"{session}.channel").alias("service_channel"), service.alias("service_vid"), F.col(f"{m}.replyId").alias("replyId"),
    ))
    rows = _messages(responses).where(mine & inside & (F.coalesce("m.feedbackId", F.lit("")) != ""))
    return schemas.conform(rows.select(
        F.col(f"{m}.feedbackId").alias("feedback_id"), F.lit("pending").alias("conversation_id"), F.lit(0).alias("msg_seq"), F.lit(channel).alias("channel"),
        F.col(f"{m}.timestamp").alias("ts_ms"), T.platform_name(F.col(f"{m}.clientInfo.platform"), F.col(f"{m}.clientInfo.device")).alias("platform"),
        info("appversion"), user.alias("user_vid"), service.alias("service_vid"), T.chat_url(url_base, F.lit(channel), service, user).alias("external_chat_url"),
        info("keyboardSource"), info("deviceName"), info("channelid"), info("enginever"), F.lit("text").alias("msgtype"),
        T.strip(empty(f"{m}.content.text")).alias("text"),
        F.array_join(F.filter(F.coalesce(f"{m}.tags", F.array().cast("array<string>")), lambda t: t != ""), "|").alias("tags"), raw.alias("raw_json"), F.lit(pulled_at).alias("pulled_at"),
    ), schemas.FEEDBACK)


def ingest_counts(responses: DataFrame, *, start_ms: int, end_ms: int) -> DataFrame:
    """One row: session_count, msg_count, user_msg_count, in_window_count, in one pass over the responses."""
    mine, inside = _wanted(start_ms, end_ms)
    rows = responses.select(F.explode("results").alias("s")).select(F.posexplode_outer("s.msgs").alias("place", "m"))
    first = F.coalesce("place", F.lit(0)) == 0  # each session has one first row, with a message or without
    return rows.agg(F.count_if(first).alias("session_count"), F.count("m").alias("msg_count"), F.count_if(mine).alias("user_msg_count"), F.count_if(mine & inside).alias("in_window_count"))


def since(table: DataFrame, column: str, *, now_ms: int, days: int = 7) -> DataFrame:
    """Rows of the last days by a time column, for an incremental copy; the filter reaches the scan."""
    return table.where(F.col(column) >= F.lit(now_ms - days * DAY_MS))


def after_mark(table: DataFrame, copied: DataFrame, key: str) -> DataFrame:
    """Rows beyond the highest key that has been copied already; the mark is read first, so the filter reaches the scan."""
    mark = copied.agg(F.max(key)).first()[0]
    return table if mark is None else table.where(F.col(key) > F.lit(mark))


def daily_export(messages: DataFrame, labels: DataFrame, conversations: DataFrame, date: str, *, hours_east: int = 8) -> dict[str, DataFrame]:
    """The three tables of one calendar day: messages by time, their labels, conversations by last time."""
    start, end = day_range(date, hours_east=hours_east)
    inside = lambda c: (F.col(c) >= start) & (F.col(c) < end)
    day = messages.where(inside("ts_ms"))
    return {"feedback": day, "message_label": labels.join(day.select("feedback_id"), "feedback_id"), "conversation_label": conversations.where(inside("last_ts_ms"))}


def lookup(table: DataFrame, **key: object) -> DataFrame:
    """At most one row by equality on any of the given columns (OR)."""
    return table.where(T.any_of(F.col(c) == F.lit(v) for c, v in key.items())).limit(1)


def backfill(messages: DataFrame, *, url_base: str = "chat") -> DataFrame:
    """Fill service_vid and the chat link of rows written before these columns were there, from raw_json and the user."""
    service = F.coalesce("service_vid", F.get_json_object("raw_json", "$.service_vid").try_cast("bigint"), F.lit(DEFAULT_SERVICE_VID)).cast("long")
    url = F.coalesce(F.nullif(F.col("external_chat_url"), F.lit("")), T.chat_url(url_base, F.col("channel"), service, F.col("user_vid")))
    return messages.withColumns({"service_vid": service, "external_chat_url": url})


def backfill_conversations(conversations: DataFrame, messages: DataFrame, *, url_base: str = "chat") -> DataFrame:
    """Fill service_vid and the chat link of conversations from their message 0, where they lack them; others keep theirs."""
    zero = messages.where("msg_seq = 0").select("conversation_id", F.col("service_vid").alias("_service"), F.col("external_chat_url").alias("_url"))
    first = zero.groupBy("conversation_id").agg(F.max("_service").alias("_service"), F.max("_url").alias("_url"))
    service = F.coalesce("service_vid", "_service", F.lit(DEFAULT_SERVICE_VID)).cast("long")
    url = F.coalesce(F.nullif(F.col("external_chat_url"), F.lit("")), F.nullif(F.col("_url"), F.lit("")), T.chat_url(url_base, F.col("channel"), service, F.col("user_vid")))
    return conversations.join(first, "conversation_id", "left").withColumns({"service_vid": service, "external_chat_url": url}).drop("_service", "_url")


def open_days(log: DataFrame, today: str, *, days: int = 30) -> DataFrame:
    """(day) of the last days, today excluded, that no run of (day, status) has finished, oldest first.

    A day that succeeded once is marked for good, however often it failed before.
    """
    end = F.to_date(F.lit(today))
    every = log.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), F.date_sub(end, 1))).alias("day"))
    done = log.where("status = 'succeeded'").select(F.col("day").cast("date").alias("day"))
    return every.join(done, "day", "left_anti").select(F.col("day").cast("string").alias("day")).orderBy("day")


def replay(days: DataFrame, run: Callable[[str], None], *, tries: int = 3) -> DataFrame:
    """Run a job for each day, up to ``tries`` times, and return what to append to the log: (day, status, error).

    A day that fails doesn't stop the others. ``days`` is short: one row a day.
    """
    rows = []
    for r in days.collect():
        for _ in range(tries):
            try:
                run(r.day)
                rows.append((r.day, "succeeded", None))
                break
            except Exception as e:  # the log names it; the day stays open
                error = f"{type(e).__name__}: {e}"[:500]
        else:
            rows.append((r.day, "failed", error))
    return days.sparkSession.createDataFrame(rows, "day string, status string, error string")
