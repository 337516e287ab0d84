"""Posts, their labels and their hits as stored tables in versions: what a crawl finds touches the buckets of its posts alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens import schemas
from feedlens.operators import posts as P
from feedlens.session import forget, settle
from feedlens.sources.snapshots import Conflict, SnapshotLog, Version

ORDER = {"posts": "last_seen_at", "labels": "labeled_at", "hits": "searched_at"}
HIT = ("post_id", "keyword", "query_name", "searched_at", "search_rank", "source_mode")


@dataclass(frozen=True)
class PostStore:
    """Versions of three tables below ``path``, dealt by post into ``buckets``."""

    path: str
    buckets: int = 8
    brands: C.Brands = C.Brands()

    def log(self, spark: SparkSession) -> SnapshotLog:
        return SnapshotLog(spark, self.path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("post_id"), F.lit(self.buckets)).cast("int")

    def _of(self, spark: SparkSession, table: str, now: Version, buckets: list[int] | None = None) -> DataFrame:
        if table in now.schemas:
            return self.log(spark).read(table, now, buckets=buckets).drop("bucket")
        none = spark.createDataFrame([], schemas.POST)
        return none if table == "posts" else P.classify_posts(none, self.brands) if table == "labels" else spark.createDataFrame([], schemas.POST_HIT)

    def table(self, spark: SparkSession, name: str, version: int | None = None) -> DataFrame:
        """posts, labels or hits, of the newest version or of another."""
        return self._of(spark, name, self.log(spark).version(version))

    def _change(self, spark: SparkSession, ids: DataFrame, make, tries: int = 5) -> None:
        """``make`` gives, from the version and the touched buckets, tables to replace in them and rows to append."""
        touched = sorted(r.bucket for r in ids.select(self._bucket().alias("bucket")).distinct().collect())  # ``buckets`` numbers at most
        for last in range(tries if touched else 0):
            log = self.log(spark)
            base = log.version()
            replaced, appended = make(base, touched)
            tables = {name: df.withColumn("bucket", self._bucket()) for name, df in (replaced | appended).items()}
            added = [f for name, df in tables.items() for f in log.stage(df, name, ORDER[name])]
            gone = [f for f in base.files if f.table in replaced and f.bucket in set(touched)]
            try:
                log.commit(base, added, gone, touched, {name: df.drop("bucket").schema.json() for name, df in tables.items()}, self.buckets)
                return
            except Conflict:
                if last + 1 == tries:
                    raise

    def take(self, found: DataFrame) -> PostStore:
        """Take in what a crawl found (post columns, searched_at, keyword, ...).

        Posts that aren't about the products are left out. Of the others the content of
        the last hit and the first time stay, their labels are made anew by rule, their hits
        are appended. A crawl that is taken in twice has the same result: hits that are there aren't appended again.
        """
        spark = found.sparkSession
        found = settle(found.where(P.relevant("text", self.brands) & (F.coalesce("post_id", F.lit("")) != "")), "found")
        ids = found.select("post_id").distinct()

        def make(base: Version, touched: list[int]):
            posts = settle(P.merge_posts(self._of(spark, "posts", base, touched), found, skip_irrelevant=False), "merged")  # ``found`` holds relevant ones alone
            held = self._of(spark, "labels", base, touched)
            mine = P.classify_posts(posts.join(ids, "post_id", "left_semi"), self.brands)
            labels = held.join(ids, "post_id", "left_anti").select(*held.columns).unionByName(mine)
            hits, known = P.new_hits(found).select(*HIT), self._of(spark, "hits", base, touched)
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in HIT]
            fresh = hits.alias("a").join(known.alias("b"), same, "left_anti")
            return {"posts": posts, "labels": labels}, {"hits": fresh}

        self._change(spark, ids, make)
        forget(found)
        return self

    def apply_replies(self, replies: DataFrame, *, labeled_at: int = 0) -> DataFrame:
        """Put a model's labels (post_id, reply) in the place of the rules'; returns the replies that can't be used. Posts that aren't stored get none."""
        spark = replies.sparkSession
        good, bad = P.reply_labels(replies, labeled_at=labeled_at)
        good = settle(good, "good")

        def make(base: Version, touched: list[int]):
            held = self._of(spark, "labels", base, touched)
            mine = good.join(self._of(spark, "posts", base, touched), "post_id", "left_semi").select(*held.columns)
            return {"labels": held.join(mine.select("post_id"), "post_id", "left_anti").select(*held.columns).unionByName(mine)}, {}

        self._change(spark, good, make)
        forget(good)
        return bad
