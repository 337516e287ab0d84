"""Labelled messages and conversations as stored tables: written once, queried many times, refreshed by batches.

Messages stand with their conversation and label, conversations with their label
and what a list shows of them. Both are dealt by user into buckets and sorted by
time inside a file. A batch writes the buckets of its users anew and changes both tables in one
version; readers go on in the version that they began with. With an index, texts and their
grams are two more tables of every version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens import schemas
from feedlens.operators.browse import PREVIEW_CHARS
from feedlens.operators.filters import Filters, check_page, narrow
from feedlens.operators.labels import aggregate_labelled
from feedlens.operators.sessionize import sessionize_all
from feedlens.operators.tagging import LABEL_COLUMNS, with_label_once
from feedlens.session import forget, settle
from feedlens.sources.merge import insert_ignore
from feedlens.operators.search import KeywordGroup
from feedlens.sources import textindex
from feedlens.sources.snapshots import Conflict, DataFile, SnapshotLog, Version

LABELS = [*LABEL_COLUMNS, "rule_name"]
#: The column that a table's files are sorted by.
ORDER = {"messages": "ts_ms", "conversations": "last_ts_ms", "texts": "block", "grams": "gram"}


def _bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _nameless() -> Column:
    return F.coalesce("user_vid", F.lit("")) == ""


def _owner() -> Column:
    """What a message's bucket follows: its user, or for one without, its own id."""
    return F.when(_nameless(), F.col("feedback_id")).otherwise(F.col("user_vid"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """Conversation labels of labelled messages with their bucket, with the platform and preview of message 0."""
    first = F.struct(F.coalesce("platform", F.lit("")).alias("platform"), F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW_CHARS).alias("preview_text"))
    return aggregate_labelled(rows, extra={"_first": F.min_by(first, "msg_seq"), "bucket": F.min("bucket")}).select("*", "_first.*").drop("_first")


@dataclass(frozen=True)
class Cursor:
    """Where a list goes on: behind a conversation of one version of the store."""

    version: int
    last_ts_ms: int
    conversation_id: str


@dataclass(frozen=True)
class LabelStore:
    """Versions of both tables below ``path``. The number of buckets is set when the store is made: ``buckets``, or one for ``bucket_rows`` messages.

    A file holds at most ``file_rows`` rows, a range of the time of its bucket.
    """

    path: str
    buckets: int | None = None
    bucket_rows: int = 250_000
    file_rows: int = 1_000_000
    gap_ms: int = C.GAP_MS
    rules: C.TagRules = C.TagRules()

    def log(self, spark: SparkSession) -> SnapshotLog:
        return SnapshotLog(spark, self.path)

    def messages(self, spark: SparkSession, version: int | None = None, **range_: int | None) -> DataFrame:
        """Messages of a version, the newest if none is named; ``since`` and ``until`` (by ts_ms, inclusive) leave out files."""
        log = self.log(spark)
        return log.read("messages", log.version(version), **range_).drop("bucket")

    def conversations(self, spark: SparkSession, version: int | None = None, **range_: int | None) -> DataFrame:
        """Conversations of a version; ``since`` and ``until`` go by last_ts_ms."""
        log = self.log(spark)
        return log.read("conversations", log.version(version), **range_).drop("bucket")

    def create(self, messages: DataFrame) -> LabelStore:
        """Find sessions, label every message and conversation, and make a version of them alone."""
        log = self.log(messages.sparkSession)
        base = log.version()
        n = self.buckets or max(1, -(-messages.count() // self.bucket_rows))
        rows = with_label_once(sessionize_all(messages, gap_ms=self.gap_ms), self.rules, texts=messages).withColumn("bucket", _bucket(_owner(), n))
        added, schema = self._stage(log, {"messages": rows})
        talks = conversations_of(log.of("messages", schema["messages"], added).withColumn("bucket", _bucket(_owner(), n)))
        more, also = self._stage(log, {"conversations": talks})
        log.commit(Version(base.number, n, {}, ()), added + more, list(base.files), list(range(n)), schema | also, n)
        return self

    def _stage(self, log: SnapshotLog, tables: dict[str, DataFrame]) -> tuple[list[DataFile], dict[str, str]]:
        files = [f for name, df in tables.items() for f in log.stage(df, name, ORDER[name], self.file_rows)]
        return files, {name: df.drop("bucket").schema.json() for name, df in tables.items()}

    def _index(self, log: SnapshotLog, rows: DataFrame) -> tuple[list[DataFile], dict[str, str]]:
        """The index tables of messages with their bucket, which ``part`` repeats in the rows."""
        own = rows.select("bucket", F.col("bucket").alias("part"), "text", "conversation_id")
        texts = settle(textindex.blocks_of(own, bucket="part"), "texts")
        grams = textindex.grams_of(texts, bucket="part", repeated=True).withColumn("bucket", F.col("part"))
        out = self._stage(log, {"texts": texts, "grams": grams})
        forget(texts)
        return out

    def add_index(self, spark: SparkSession) -> LabelStore:
        """Index the texts of the newest version, if they aren't; every refresh then keeps the index up."""
        log = self.log(spark)
        base = log.version()
        if "texts" not in base.schemas:
            rows = log.read("messages", base).withColumn("bucket", _bucket(_owner(), base.buckets))
            added, schema = self._index(log, rows)
            log.commit(base, added, [], list(range(base.buckets)), schema, base.buckets)
        return self

    def keyword_search(self, spark: SparkSession, groups: Sequence[KeywordGroup], excludes: Sequence[str] = (), version: int | None = None) -> DataFrame:
        """Conversations with a message that fits one of the groups, and none with an excluded word, by the index."""
        log = self.log(spark)
        now = log.version(version)

        def found(groups: Sequence[KeywordGroup]) -> DataFrame:
            asked, _ = textindex.gram_condition(groups)
            grams = log.read("grams", now, since=min(asked), until=max(asked)) if asked else log.read("grams", now)
            return textindex.search_texts(log.read("texts", now), grams, groups, bucket="part").select("conversation_id")

        out = log.read("conversations", now).join(found(groups), "conversation_id", "left_semi")
        return out.join(found([KeywordGroup(excludes, "OR")]), "conversation_id", "left_anti") if excludes else out

    def page(self, spark: SparkSession, f: Filters = Filters(), *, after: Cursor | None = None, limit: int = 50, span_ms: int = C.DAY_MS) -> tuple[DataFrame, Cursor | None]:
        """(a page of conversations that pass, newest first, equal times by id; where the next one begins, None at the end).

        A page begins behind ``after``, in that version. The time before it is read
        by spans, each four times as long as the one before, until the page is full: only files and row
        groups of these times are opened, for a late page as few as for the first. Nothing
        before the page is sorted again.
        """
        check_page(limit, 0)
        log = self.log(spark)
        now = log.version(after.version if after else None)
        files = [x for x in now.files if x.table == "conversations"]
        if not files:
            return log.read("conversations", now), None
        lowest, top = min(x.low for x in files), after.last_ts_ms if after else max(x.high for x in files)
        messages, span = log.read("messages", now, until=top), span_ms
        while True:
            since = top - span
            rows = log.read("conversations", now, since=since, until=top).where(F.col("last_ts_ms").between(since, top))
            if after:
                rows = rows.where((F.col("last_ts_ms") < top) | (F.col("conversation_id") > after.conversation_id))
            best = narrow(rows, messages, f).orderBy(F.desc("last_ts_ms"), "conversation_id").limit(limit)
            found = best.select("last_ts_ms", "conversation_id").collect()  # ``limit`` rows at most
            if len(found) == limit or since <= lowest:
                return best, Cursor(now.number, *found[-1]) if len(found) == limit else None
            span *= 4

    def refresh(self, batch: DataFrame, *, tries: int = 5) -> LabelStore:
        """Take in a batch of messages: new, late, or delivered before.

        All users of whom the batch has a message that isn't stored yet are sessionized again over their whole history.
        Messages keep the label that they have, only new ones are
        tagged; the conversations of these users are aggregated again, and stale
        ones go. Files of the buckets that hold them are written anew; of others only those that may hold
        a message of the batch are read. A batch that runs twice, or again after a failure, has the same result,
        and one of known messages alone makes no version. If
        another batch changed one of the buckets meanwhile, this one starts again
        from that version. A message's id belongs to its user: an id that comes again with another user isn't looked for among all others.
        """
        batch = settle(schemas.conform(batch, schemas.FEEDBACK), "batch")
        try:
            for last in range(tries):
                try:
                    self._refresh(batch)
                    return self
                except Conflict:
                    if last + 1 == tries:
                        raise
        finally:
            forget(batch)
        return self

    def _refresh(self, batch: DataFrame) -> None:
        log = self.log(batch.sparkSession)
        base = log.version()
        n = base.buckets
        buckets_of = lambda df: [r.bucket for r in df.select(_bucket(_owner(), n).alias("bucket")).distinct().collect()]  # noqa: E731 - n numbers at most
        asked = buckets_of(batch)
        if not asked:
            return
        fresh = settle(insert_ignore(log.read("messages", base, buckets=asked), batch, "feedback_id", order="ts_ms"), "fresh")
        touched = buckets_of(fresh)
        if not touched:  # all known: their users' sessions and labels stand as they are
            forget(fresh)
            return
        held = log.read("messages", base, buckets=touched)
        users = fresh.where(~_nameless()).select("user_vid").distinct()
        columns = [c for c in fresh.columns if c not in ("conversation_id", "msg_seq")]
        known = held.join(users, "user_vid", "left_semi").select(*columns, *LABELS)
        told = settle(with_label_once(fresh.select(*columns), self.rules).select(*columns, *LABELS), "told")
        new = sessionize_all(known.unionByName(told), gap_ms=self.gap_ms).select(*held.columns)
        new = settle(new.withColumn("bucket", _bucket(_owner(), n)), "labelled")
        rest = held.join(users, "user_vid", "left_anti").select(*held.columns).withColumn("bucket", _bucket(_owner(), n))
        stay = log.read("conversations", base, buckets=touched)
        # a message without a user is a conversation of its own, whose id names its bucket through the message alone
        lone = new.where(_nameless()).select("conversation_id", "bucket")
        own = F.when(~_nameless(), _bucket(F.col("user_vid"), n))
        stay = stay.join(users, "user_vid", "left_anti").select(*stay.columns).join(lone.select("conversation_id"), "conversation_id", "left_anti").select(*stay.columns)
        named, nameless = stay.where(~_nameless()).withColumn("bucket", own), stay.where(_nameless())
        nameless = nameless.join(rest.where(_nameless()).select("conversation_id", "bucket"), "conversation_id")
        talks = conversations_of(new)
        talks = talks.unionByName(named.select(*talks.columns)).unionByName(nameless.select(*talks.columns))
        added, schema = self._stage(log, {"messages": rest.unionByName(new), "conversations": talks})
        if "texts" in base.schemas:
            whole = log.of("messages", schema["messages"], [f for f in added if f.table == "messages"])
            added += self._index(log, whole.withColumn("bucket", _bucket(_owner(), n)))[0]
        gone = set(touched)
        log.commit(base, added, [f for f in base.files if f.bucket in gone], touched, {}, n)
        forget(fresh, told, new)
