"""A stream of labelled messages as a stream of changed conversation labels.

Each user's conversations that can still change are kept as state: of messages
older than the watermark, before which nothing comes any more, one folded row of
the conversation that they leave open; all later ones by themselves. A late
message that opens a conversation earlier changes its id, one between two
joins them: what was shown under an id that is gone is taken back. A user whose last
conversation is closed for good leaves no state.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedlens import config as C
from feedlens.operators.labels import label_ranks, tags_of_bits
from feedlens.operators.sessionize import user_key
from feedlens.operators.tagging import with_label
from feedlens.session import dealt

META = "user_vid string, appversion string, channel string, service_vid long, external_chat_url string"
LABEL = "rank int, L1 string, confidence double, reason string, source string, severity_rank int, severity string, bits int"
MESSAGE = f"ts_ms long, feedback_id string, {LABEL}, {META}"
FOLDED = f"first_ts_ms long, last_ts_ms long, msg_count long, {LABEL}, {META}"
CHANGE = f"op string, conversation_id string, {FOLDED}"
_LABEL, _META = ([c.split()[0] for c in s.split(", ")] for s in (LABEL, META))
_FOLDED = [c.split()[0] for c in FOLDED.split(", ")]
_MESSAGE = [c.split()[0] for c in MESSAGE.split(", ")]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(open_: dict | None, m: dict) -> dict:
    """A conversation with one more message, the next in the order of (ts_ms, feedback_id)."""
    if open_ is None:
        return {"first_ts_ms": m["ts_ms"], "last_ts_ms": m["ts_ms"], "msg_count": 1} | {c: m[c] for c in (*_LABEL, *_META)}
    out = open_ | {"last_ts_ms": m["ts_ms"], "msg_count": open_["msg_count"] + 1, "bits": open_["bits"] | m["bits"]}
    if (m["rank"], m["confidence"]) > (open_["rank"], open_["confidence"]):  # the first of equals stays
        out |= {c: m[c] for c in ("rank", "L1", "confidence", "reason", "source")}
    if m["severity_rank"] > open_["severity_rank"]:
        out |= {c: m[c] for c in ("severity_rank", "severity")}
    return out


class OpenConversations(StatefulProcessor):
    """The conversations of one user key: (op, conversation_id, ...) of those that a batch changes."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", FOLDED)
        self.recent = handle.getListState("recent", MESSAGE)
        self.shown = handle.getListState("shown", "conversation_id string, mark string")  # read and written as a whole: a call for each conversation takes most of a batch's time

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = [dict(zip(_MESSAGE, r, strict=True)) for r in (self.recent.get() if self.recent.exists() else ())]
        seen = {m["feedback_id"]: m for m in known}
        for r in sorted((r.asDict() for r in rows), key=lambda m: (m["ts_ms"], m["feedback_id"])):
            seen.setdefault(r["feedback_id"], {c: r[c] for c in _MESSAGE})  # the first delivery of an id counts
        messages = sorted(seen.values(), key=lambda m: (m["ts_ms"], m["feedback_id"]))
        open_ = dict(zip(_FOLDED, self.folded.get(), strict=True)) if self.folded.exists() else None
        settled = timerValues.getCurrentWatermarkInMs()
        found, base, left = [], open_, []
        for m in messages:
            if open_ is not None and m["ts_ms"] - open_["last_ts_ms"] > self.gap:
                found.append(open_)
                open_ = None
            open_ = fold(open_, m)
            if m["ts_ms"] < settled:
                base = open_  # nothing comes before this message any more
            else:
                left.append(m)
        found.append(open_)
        now = {self._id(key[0], c["first_ts_ms"]): c for c in found}
        marks = {name: hashlib.sha1(json.dumps(c, sort_keys=True).encode()).hexdigest() for name, c in now.items()}
        before = {r[0]: r[1] for r in (self.shown.get() if self.shown.exists() else ())}
        for name in before.keys() - now.keys():
            yield Row(op="delete", conversation_id=name, **dict.fromkeys(_FOLDED))
        for name, c in now.items():
            if before.get(name) != marks[name]:
                yield Row(op="upsert", conversation_id=name, **c)
        if base is not None:
            self.folded.update(tuple(base[c] for c in _FOLDED))
        self._put(self.recent, [tuple(m[c] for c in _MESSAGE) for m in left])
        still = self._still(key[0], base, left)
        self._put(self.shown, [(name, mark) for name, mark in marks.items() if name in still])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(open_["last_ts_ms"] + self.gap + 1)

    def _id(self, key: str, first_ts_ms: int) -> str:
        return hashlib.sha1(f"{key}:{first_ts_ms}".encode()).hexdigest()[:12]

    def _put(self, state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def _still(self, key: str, base: dict | None, left: list[dict]) -> set[str]:
        """The ids of conversations that can still change: none of those before the one that is folded."""
        still = {self._id(key, base["first_ts_ms"])} if base else set()
        last = base
        for m in left:
            if last is not None and m["ts_ms"] - last["last_ts_ms"] > self.gap:
                last = None
            last = fold(last, m)
            still.add(self._id(key, last["first_ts_ms"]))
        return still

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.folded.clear()
        self.recent.clear()
        self.shown.clear()
        return iter(())

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession):
    """State stores of streams that start inside are RocksDB's, as state of several variables needs; the session's setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def conversation_changes(messages: DataFrame, *, gap_ms: int = C.GAP_MS, late: str = "1 day", rules: C.TagRules = C.TagRules()) -> DataFrame:
    """The changes of conversation labels that a stream of messages of the feedback schema makes.

    (op, conversation_id, L1, L2, severity, confidence, reason, source,
    msg_count, first_ts_ms, last_ts_ms, user_vid, ...): 'upsert' with the label
    as it is now, 'delete' for an id that is gone, at most one row of an id in a batch. Messages later than
    ``late`` behind the newest are dropped by the watermark. Start the stream inside ``rocks``.
    """
    told = label_ranks(with_label(dealt(messages), rules))
    keyed = told.select(user_key(F.col("user_vid"), F.col("feedback_id")).alias("_key"), F.timestamp_millis("ts_ms").alias("ts"), *_MESSAGE).withWatermark("ts", late)
    found = keyed.groupBy("_key").transformWithState(OpenConversations(gap_ms), outputStructType=CHANGE, outputMode="Update", timeMode="EventTime")
    return found.select("op", "conversation_id", "L1", tags_of_bits(F.col("bits")).alias("L2"), "severity", "confidence", "reason", "source", "msg_count", "first_ts_ms", "last_ts_ms", *_META)


def keep_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived as one folder for each batch, replaced if the batch runs again, and stop."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with rocks(changes.sparkSession):
        return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def current(changes: DataFrame) -> DataFrame:
    """The conversations as they are after all kept changes: of each id the last one, unless it took the id back."""
    columns = [c for c in changes.columns if c not in ("batch", "op")]
    last = changes.groupBy("conversation_id").agg(F.max_by(F.struct("op", *columns), "batch").alias("_last"))
    return last.where("_last.op = 'upsert'").select("_last.*").drop("op")
