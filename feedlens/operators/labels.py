"""One label for each conversation from the labels of its messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import config as C


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def tag_bits(tags: Column) -> Column:
    """A list of tags as a bit mask, in the order of their values; others count nothing."""
    bit = _map({v: 1 << k for k, v in enumerate(C.L2_VALUES)})
    return F.aggregate(F.coalesce(tags, F.array().cast("array<string>")), F.lit(0), lambda acc, x: acc.bitwiseOR(F.coalesce(bit[x], F.lit(0))))


def tags_of_bits(bits: Column) -> Column:
    """The tags of a bit mask, sorted and joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(bits.bitwiseAND(1 << C.L2_VALUES.index(v)) != 0, F.lit(v)) for v in sorted(C.L2_VALUES)])), "|")


def label_ranks(rows: DataFrame) -> DataFrame:
    """Adds rank, severity_rank and bits to labelled messages: what a label of several is made of."""
    return rows.withColumns({"rank": _map(C.L1_PRIORITY)[F.col("L1")], "severity_rank": _map(C.SEVERITY_PRIORITY)[F.col("severity")], "bits": tag_bits(F.col("L2"))})


def aggregate_labels(messages: DataFrame, labels: DataFrame, *, aggregated_at: int = 0) -> DataFrame:
    """Conversation labels of messages (feedback_id, conversation_id, msg_seq, ts_ms, user_vid, ...) and their labels, kept as a table of their own."""
    return aggregate_labelled(messages.join(labels.select("feedback_id", "L1", "L2", "severity", "confidence", "reason", "source"), "feedback_id"), aggregated_at=aggregated_at)


def aggregate_labelled(rows: DataFrame, *, aggregated_at: int = 0, extra: dict[str, Column] | None = None) -> DataFrame:
    """Conversation labels of messages that have their label beside them: one exchange, by conversation.

    Only labelled messages count. L1 is the most serious; confidence and reason
    are the surest message's of that L1, the first of equals; severity is the
    most serious, on its own; L2 is the union of tags. User, version and channel
    come from message 0, else from the earliest. ``extra`` are more aggregates by name. The union is a bit mask, so the
    state of a group doesn't grow with the conversation.
    """
    rows = rows.where("L1 is not null")
    rank = _map(C.L1_PRIORITY)[F.col("L1")]
    bits = tag_bits(F.col("L2"))
    meta = F.struct("user_vid", "appversion", "channel", "service_vid", "external_chat_url")
    zero = F.col("msg_seq") == 0
    out = rows.groupBy("conversation_id").agg(
        F.max_by(F.struct("L1", "confidence", "reason", "source"), F.struct(rank, "confidence", -F.col("msg_seq"))).alias("_top"),
        F.max_by("severity", _map(C.SEVERITY_PRIORITY)[F.col("severity")]).alias("severity"),
        F.bit_or(bits).alias("_bits"),
        F.count("*").alias("msg_count"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"),
        F.min_by(meta, F.struct(F.when(zero, 0).otherwise(1), "ts_ms", "msg_seq")).alias("_meta"), *[c.alias(name) for name, c in (extra or {}).items()],
    )
    return out.select(
        "conversation_id", "_top.L1", tags_of_bits(F.col("_bits")).alias("L2"), "severity", "_top.confidence", "_top.reason", "_top.source",
        "msg_count", "first_ts_ms", "last_ts_ms", "_meta.*", F.lit(aggregated_at).cast("long").alias("aggregated_at"), *(extra or {}),
    )
