"""Daily panes of counts: a range of time is answered by adding up its days, and a late conversation replaces its days alone.

A pane holds, of the conversations whose last message is of its day, the
partial counts of every signature and version, the candidates that they are
counted from, and the conversations of each hour and L1. Panes follow the
versions of a store of labels: days are made anew where a conversation changed between
two versions. What asks them reads no message.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens.functions import text as T
from feedlens.operators import ranking as R
from feedlens.session import forget, settle
from feedlens.sources.snapshots import SnapshotLog
from feedlens.sources.store import LabelStore

ORDER = {"signatures": "last", "candidates": "last_ts_ms", "trend": "hour"}
_ONE_DAY = "day"


def _day(c: str):
    return F.floor(F.col(c) / C.DAY_MS).cast("int")


@dataclass(frozen=True)
class Panes:
    """Panes below ``path`` of the conversations of ``source``."""

    path: str
    source: LabelStore
    rules: C.SignatureRules = C.SignatureRules()

    def log(self, spark: SparkSession) -> SnapshotLog:
        return SnapshotLog(spark, self.path)

    def refresh(self, spark: SparkSession) -> list[int]:
        """Bring the panes to the source's newest version; returns the days that were made anew.

        The version that they stand for is a mark of the source's log; a refresh that
        fails before the mark is set makes the same days again. If the source has swept that version, all days are made anew.
        """
        labels, log = self.source.log(spark), self.log(spark)
        name = self.path.rsplit("/", 1)[-1]
        seen, newest = labels.mark(name), labels.latest()
        base = log.version()
        if seen == newest and base.number:
            return []
        if seen and base.number and seen in labels.numbers():
            changed = labels.changes("conversations", "conversation_id", seen, newest)
            moved = labels.changes("conversations", "conversation_id", newest, seen)  # an update's old day
            days = sorted(r.day for r in changed.select(_day("last_ts_ms").alias("day")).union(moved.select(_day("last_ts_ms"))).distinct().collect())  # one row a day
        else:
            days = None
        if days != []:
            self._write(spark, log, base, newest, days)
        labels.set_mark(name, newest)
        return days if days is not None else sorted({f.bucket for f in log.version().files})

    def _write(self, spark: SparkSession, log: SnapshotLog, base, version: int, days: list[int] | None) -> None:
        range_ = {} if days is None else {"since": days[0] * C.DAY_MS, "until": (days[-1] + 1) * C.DAY_MS - 1}
        talks = self.source.conversations(spark, version, **range_)
        if days is not None:
            talks = talks.where(_day("last_ts_ms").isin(days))
        # messages of these conversations can't be newer than their last ones
        messages = self.source.messages(spark, version, until=range_.get("until"))
        found = R.signature_rows(R.candidates(talks, messages, now_ms=0, days=0, rules=self.rules), self.rules)
        rows = settle(found.withColumn("bucket", _day("last_ts_ms")), "candidates")
        hour = F.floor(F.col("last_ts_ms") / 3_600_000)
        tables = {
            "candidates": rows, "signatures": R.signature_partials(rows, "bucket"),
            "trend": talks.groupBy(_day("last_ts_ms").alias("bucket"), (hour * 3_600_000).alias("hour"), "L1").agg(F.count("*").alias("n")),
        }
        added = [f for t, df in tables.items() for f in log.stage(df, t, ORDER[t])]
        gone = [f for f in base.files if days is None or f.bucket in set(days)]
        touched = sorted({f.bucket for f in (*added, *gone)})
        log.commit(base, added, gone, touched, {t: df.drop("bucket").schema.json() for t, df in tables.items()}, 0)
        forget(rows)

    def signatures(self, spark: SparkSession, *, now_ms: int, days: int = 7) -> DataFrame:
        """The scored signatures of the last ``days`` before ``now_ms``, as ``score_groups`` of their candidates gives.

        Whole days come from their partials, the day in which the range begins from its candidates.
        """
        log = self.log(spark)
        now = log.version()
        start = now_ms - days * C.DAY_MS
        first = start // C.DAY_MS
        whole = log.read("signatures", now, buckets=[f.bucket for f in now.files if f.bucket > first])
        edge = log.read("candidates", now, buckets=[first]).where(F.col("last_ts_ms") >= start)
        return R.merge_partials(whole.unionByName(R.signature_partials(edge)), now_ms=now_ms, rules=self.rules)

    def trend(self, spark: SparkSession, granularity: str = "day", *, since: int | None = None, until: int | None = None) -> DataFrame:
        """(bucket, L1, n) as ``browse.trend`` gives, of the hours from ``since`` to ``until``."""
        log = self.log(spark)
        rows = log.read("trend", log.version(), since=since, until=until)
        inside = T.all_of([F.col("hour") >= since] * (since is not None) + [F.col("hour") <= until] * (until is not None))
        return rows.where(inside).groupBy(T.time_bucket(F.col("hour"), granularity).alias("bucket"), "L1").agg(F.sum("n").alias("n"))

    def sliding(self, spark: SparkSession, days: int = 7) -> DataFrame:
        """(bucket, L1, n): for every day that has a pane, the conversations of the ``days`` days that end with it."""
        log = self.log(spark)
        per = log.read("trend", log.version()).groupBy(_day("hour").alias("day"), "L1").agg(F.sum("n").alias("n"))
        ends = per.select("day").distinct().withColumnRenamed("day", "end")
        covers = per.select("L1", "n", F.explode(F.sequence("day", F.col("day") + days - 1)).alias("end"))
        shown = F.date_format(F.timestamp_millis(F.col("end").cast("long") * C.DAY_MS), "yyyy-MM-dd")
        return covers.join(ends, "end").groupBy(shown.alias("bucket"), "L1").agg(F.sum("n").alias("n"))
