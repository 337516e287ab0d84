"""Structured Streaming over messages: sessions, trends, late data, incremental recomputation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TIME = "ts"


def stream_sessions(messages: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, msg_count) of (user_id, ts): sessions by gap, closed when the watermark passes.

    An event exactly one gap later still belongs to its session, as in the batch operator.
    """
    by = F.session_window(TIME, gap)
    out = messages.withWatermark(TIME, late).groupBy("user_id", by).agg(F.count("*").alias("msg_count"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "msg_count")


def stream_trend(messages: DataFrame, *, bucket: str = "1 day", slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(bucket_start, <by>, n) in tumbling windows, or sliding ones (7 days every day) with ``slide``."""
    window = F.window(TIME, bucket, slide) if slide else F.window(TIME, bucket)
    return messages.withWatermark(TIME, late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket_start"), by, "n")


def stream_dedup(messages: DataFrame, key: str, *, late: str = "1 day") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return messages.withWatermark(TIME, late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Process what has arrived since the last run and stop: the trigger for an external schedule."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
