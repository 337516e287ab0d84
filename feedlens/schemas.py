"""Table schemas of the feedback and post domains, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FEEDBACK = (
    "feedback_id string, conversation_id string, msg_seq int, channel string, ts_ms bigint, platform string, appversion string, user_vid string, "
    "service_vid bigint, external_chat_url string, keyboard_source string, device_name string, channelid string, enginever string, msgtype string, "
    "text string, tags string, raw_json string, pulled_at bigint"
)
MESSAGE_LABEL = "feedback_id string, L1 string, L2 array<string>, severity string, confidence double, reason string, source string, rule_name string, tagged_at bigint"
CONVERSATION_LABEL = (
    "conversation_id string, L1 string, L2 string, severity string, confidence double, reason string, source string, msg_count bigint, first_ts_ms bigint, "
    "last_ts_ms bigint, user_vid string, appversion string, channel string, service_vid bigint, external_chat_url string, aggregated_at bigint"
)
PUSH_LOG = (
    "push_date string, rank int, signature string, group_id string, primary_l2 string, major_version string, representative_conversation_id string, "
    "representative_feedback_id string, score double, dup_count bigint, p0_count bigint, cross_version int, affected_versions string, "
    "representative_text string, created_at bigint, delivered_at bigint, is_empty int"
)
POST = (
    "post_id string, url string, author_id string, author_name string, author_verified boolean, created_at_raw string, created_at_ms bigint, text string, "
    "pic_urls array<string>, reposts_count int, comments_count int, attitudes_count int, first_seen_at bigint, last_seen_at bigint"
)
POST_HIT = "post_id string, keyword string, query_name string, searched_at bigint, search_rank int, source_mode string"
POST_LABEL = "post_id string, brand_focus string, sentiment string, topics array<string>, post_type string, risk_level string, confidence double, reason string, label_source string, labeled_at bigint"
#: One response of the message service: sessions of messages.
RAW_RESPONSE = (
    "errCode int, results array<struct<session: struct<userVid: string, channel: string, serviceVid: bigint>, msgs: array<struct<sender: int, type: string, "
    "timestamp: bigint, feedbackId: string, replyId: string, content: struct<text: string, url: string, scheme: string>, "
    "clientInfo: struct<platform: int, os: int, appversion: string, device: string, deviceName: string, channelid: string, enginever: string, keyboardSource: string>, "
    "user: struct<userVid: string>, tags: array<string>>>>>"
)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, in its order and types: missing ones null, others dropped."""
    own = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])
