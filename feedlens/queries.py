"""Queries on the test tables, one or more for each operator: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import adapters as A
from feedlens import config as C
from feedlens.functions import text as T
from feedlens.operators import browse as B
from feedlens.operators import filters as FL
from feedlens.operators import posts as P
from feedlens.operators import ranking as R
from feedlens.operators import reports as RP
from feedlens.operators import search as S
from feedlens.operators import tagging
from feedlens.operators.labels import aggregate_labelled
from feedlens.operators.sessionize import conversation_spans, sessionize_all, sessionize_split
from feedlens.plans import intent as I
from feedlens.session import dealt, settle
from feedlens.sources import merge as M
from feedlens.sources import messages as SM
from feedlens.sources import textindex as TI

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DATE = "2024-01-10"
START_MS, END_MS = 1_704_844_800_000, 1_705_449_600_000  # 10 to 17 January 2024


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def _facts(spark, d):
    """Stored messages, which hold their labels, and stored conversations."""
    store = A.store(spark, d)
    return store.messages(spark), store.conversations(spark)


# --- messages and sessions ---------------------------------------------------
@query
def sessionize_events(spark, d):
    rows = A.events(spark, d).select(F.concat(F.lit("e"), "event_id").alias("feedback_id"), F.concat(F.lit("u"), "user_id").alias("user_vid"), "ts_ms")
    return conversation_spans(sessionize_all(rows))


@query
def sessionize_by_span(spark, d):
    rows = A.messages(spark, d).select("feedback_id", "user_vid", "ts_ms")
    return sessionize_split(rows, gap_ms=A.LONG_GAP_MS).select("feedback_id", "conversation_id", F.col("msg_seq").cast("long").alias("msg_seq"))


@query
def session_anonymous(spark, d):
    return A.sessions(spark, d).where("user_vid is null").select("feedback_id", "conversation_id", F.col("msg_seq").cast("long").alias("msg_seq"))


@query
def flatten_messages(spark, d):
    rows = SM.flatten_responses(A.responses(spark, d), start_ms=START_MS, end_ms=END_MS, channel="app")
    return rows.select("feedback_id", "ts_ms", "platform", "appversion", "user_vid", "service_vid", "external_chat_url", "device_name", "text", "tags")


@query
def ingest_counters(spark, d):
    return SM.ingest_counts(A.responses(spark, d), start_ms=START_MS, end_ms=END_MS)


@query
def platform_decode(spark, d):
    e = A.events(spark, d)
    code, device = A.pick((1, 2, 7, 9, 11, 5, None), F.col("k")), A.pick(("my iPad", "ANDROID 14", "win64 box", "macOS 14", "", None), F.col("event_id"))
    return e.groupBy(T.platform_name(code, device).alias("platform")).agg(F.count("*").alias("n"))


@query
def incremental_scan(spark, d):
    return SM.since(A.messages(spark, d), "ts_ms", now_ms=A.NOW_MS, days=7).select("feedback_id", "ts_ms")


@query
def high_water_mark(spark, d):
    e = A.events(spark, d).select("event_id", "event_type")
    return SM.after_mark(e, e.where("event_type = 'purchase'"), "event_id")


@query
def daily_export_utc8(spark, d):
    rows, conversations = _facts(spark, d)
    out = SM.daily_export(rows, rows.select("feedback_id", *tagging.LABEL_COLUMNS), conversations, DATE)
    ids = [out[t].select(F.lit(t).alias("table"), F.col(k).alias("id")) for t, k in (("feedback", "feedback_id"), ("message_label", "feedback_id"), ("conversation_label", "conversation_id"))]
    return ids[0].union(ids[1]).union(ids[2])


@query
def point_lookup(spark, d):
    return SM.lookup(A.messages(spark, d), feedback_id="e77").select("feedback_id", "text", "platform")


@query
def backfill_columns(spark, d):
    return SM.backfill(A.messages(spark, d)).select("feedback_id", "service_vid", "external_chat_url")


@query
def messages_per_conversation(spark, d):
    return B.messages_per_conversation(A.sessions(spark, d))


# --- merges ------------------------------------------------------------------
@query
def insert_ignore(spark, d):
    """All messages, twice, into a table that has those of purchases."""
    e = A.events(spark, d).select(F.concat(F.lit("e"), "event_id").alias("feedback_id"), "event_type", A.pick(A.PHRASES, F.col("event_id")).alias("text"))
    all_ = e.drop("event_type")
    return M.insert_ignore(e.where("event_type = 'purchase'").drop("event_type"), all_.union(all_), "feedback_id")


@query
def insert_counts(spark, d):
    e = A.events(spark, d).select("event_id", "event_type")
    return M.insert_counts(e.where("event_type = 'purchase'"), e.union(e), "event_id")


@query
def upsert_latest(spark, d):
    e = A.events(spark, d).select("user_id", "event_id", "event_type", "ts_ms")
    return M.upsert_latest(e.where("event_type <> 'error'"), e.where("event_type = 'error'"), "user_id", "ts_ms")


@query
def quarantine_rows(spark, d):
    rows = tagging.tag_messages(A.messages(spark, d)).withColumn("n", F.substring("feedback_id", 2, 20).cast("long"))
    rows = rows.withColumns({"L1": F.when(F.col("n") % 101 == 0, "?").otherwise(F.col("L1")), "confidence": F.when(F.col("n") % 103 == 0, 1.5).otherwise(F.col("confidence"))})
    good, bad = M.split_valid(rows, M.label_problem())
    return good.agg(F.lit("").alias("problem"), F.count("*").alias("n")).union(bad.groupBy("problem").agg(F.count("*").alias("n")))


@query
def integrity_orphans(spark, d):
    return M.orphans(A.table(spark, d, "labels"), A.table(spark, d, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


# --- labels ------------------------------------------------------------------
@query
def rule_tagger(spark, d):
    found = tagging.with_rule_label(dealt(A.messages(spark, d).select("feedback_id", "text")))
    return found.where("rule_name is not null").select("feedback_id", "L1", joined("L2"), "severity", "confidence", "reason", "rule_name")


@query
def tag_run_stats(spark, d):
    """By rule, and by a model's replies for the rest."""
    n = F.substring("feedback_id", 2, 20).cast("long")
    return tagging.tag_stats(tagging.tag_messages(A.messages(spark, d), reply=A.pick(A.REPLIES, n)))


@query
def llm_reply_parse(spark, d):
    e = A.events(spark, d).select("event_id", tagging.parse_reply(A.pick(A.REPLIES, F.col("event_id"))).alias("l"))
    return e.select("event_id", "l.L1", F.array_join("l.L2", "|").alias("L2"), "l.severity", "l.confidence", "l.reason")


def _untagged(spark, d) -> DataFrame:
    m = A.messages(spark, d).select("feedback_id", "ts_ms", "text")
    tagged = tagging.tag_messages(m).where("L1 <> '待定'")
    return tagging.untagged(m, tagged).select("feedback_id", "ts_ms")


@query
def untagged_messages(spark, d):
    return _untagged(spark, d)


@query
def conversation_labels(spark, d):
    return aggregate_labelled(tagging.with_label(A.sessions(spark, d))).select("conversation_id", "L1", "L2", "severity", "confidence", "reason", "msg_count", "first_ts_ms", "last_ts_ms", "user_vid", "appversion")


# --- lists and filters -------------------------------------------------------
_LISTED = ("conversation_id", "L1", "L2", "severity", "msg_count", "last_ts_ms", "service_vid", "external_chat_url", "platform", "preview_text")


@query
def conversation_list_filtered(spark, d):
    rows, conversations = _facts(spark, d)
    f = FL.Filters(since="2024-01-05", until="2024-01-25", L1="A.Bug", L2="性能", platform="iOS, Android")
    return B.list_conversations(conversations, rows, f, limit=50, offset=5).select(*_LISTED)


@query
def conversation_list_text(spark, d):
    rows, conversations = _facts(spark, d)
    return B.list_conversations(conversations, rows, FL.Filters(severity="P0", q="CRASH"), limit=100).select(*_LISTED)


@query
def conversation_detail(spark, d):
    rows, _ = _facts(spark, d)
    (one,) = SM.lookup(rows, feedback_id="e77").select("conversation_id").collect()
    out = B.detail(one.conversation_id, rows.drop(*tagging.LABEL_COLUMNS, "rule_name"), rows)
    return out.select("feedback_id", F.col("msg_seq").cast("long").alias("msg_seq"), "ts_ms", "text", "platform", "L1", joined("L2"), "severity", "confidence", "rule_name")


@query
def metadata_filters(spark, d):
    rows, conversations = _facts(spark, d)
    f = FL.Filters(appversion="3.1,5", device_name="pixel, thinkpad")
    return FL.narrow(conversations, rows, f).select("conversation_id", "appversion", "last_ts_ms")


@query
def csv_export(spark, d):
    rows, conversations = _facts(spark, d)
    items = B.list_conversations(conversations, rows, FL.Filters(L1="A.Bug"), limit=5000, most=5000)
    return M.csv_rows(items)


@query
def latest_conversations(spark, d):
    rows, conversations = _facts(spark, d)
    return B.list_conversations(conversations.where("L1 = '待定'"), rows, limit=10).select("conversation_id", "last_ts_ms", "preview_text")


# --- search ------------------------------------------------------------------
def _ids(df: DataFrame) -> DataFrame:
    return df.select("conversation_id", "L1", "last_ts_ms")


@query
def keyword_search_and_or(spark, d):
    rows, conversations = _facts(spark, d)
    return _ids(S.keyword_search(conversations, rows, [S.KeywordGroup(["键盘", "卡顿"]), S.KeywordGroup(["crash", "白屏"], "OR"), S.KeywordGroup([])]))


@query
def keyword_search_exclude(spark, d):
    rows, conversations = _facts(spark, d)
    return _ids(S.keyword_search(conversations, rows, [S.KeywordGroup(["闪退", "乱码"], "OR")], ["好用", "Bug"]))


@query
def intent_search(spark, d):
    rows, conversations = _facts(spark, d)
    return _ids(S.intent_search(conversations, rows, S.Intent(must=[["语音", "麦克风"], ["用不了", "不准"]], exclude=["垃圾"])))


@query
def intent_search_should(spark, d):
    rows, conversations = _facts(spark, d)
    return _ids(S.intent_search(conversations, rows, S.Intent(should=[["皮肤"], ["主题", "壁纸"]])))


@query
def regex_search_guarded(spark, d):
    rows, conversations = _facts(spark, d)
    patterns = S.PatternGroups([(["语音.*用不了", "crash|闪退"], "OR"), (["(a+)+", "UPDATE"], "AND")], "OR")
    return _ids(S.regex_search(conversations, rows, patterns))


@query
def fallback_keywords(spark, d):
    docs = A.table(spark, d, "documents")
    words = S.plain_words_column(F.col("text"))
    return docs.select("doc_id", F.array_join(words, "|").alias("words"))


@query
def canonical_plan_search(spark, d):
    rows, conversations = _facts(spark, d)
    found, _ = I.smart_search(conversations, rows, "Android 语音输入 不好用")
    return _ids(found)


@query
def smart_search_metadata(spark, d):
    rows, conversations = _facts(spark, d)
    found, _ = I.smart_search(conversations, rows, "iOS端 4.1 反馈")
    return _ids(found)


@query
def indexed_keyword_search(spark, d):
    """keyword_search_and_or with an excluded word, by the store's index."""
    store = A.store(spark, d).add_index(spark)
    return _ids(store.keyword_search(spark, [S.KeywordGroup(["键盘", "卡顿"]), S.KeywordGroup(["crash", "白屏"], "OR"), S.KeywordGroup([])], ["Bug"]))


@query
def indexed_document_search(spark, d):
    """Documents by their index: words with and without a neighbour, of one character, and of both cases."""
    texts, grams = A.document_index(spark, d)
    found = TI.search_texts(texts, grams, [S.KeywordGroup(["License", "©"]), S.KeywordGroup(["zq", "the OF"], "OR"), S.KeywordGroup(["@", "http"])])
    return found.select("doc_id", "lang", "n_chars")


@query
def chat_keyword_search(spark, d):
    """Chats with a user's message that has both words and none with the third, over the conversations table."""
    chats = A.chats(spark, d).where("role = 'user'")
    ids = chats.select("conversation_id").distinct()
    return S.keyword_search(ids, chats, [S.KeywordGroup(["the", "ING"])], ["zz"])


@query
def document_search(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.where(T.contains_fold(F.col("text"), "License") | T.contains_fold(F.col("text"), "the of")).select("doc_id", "lang", "n_chars")


@query
def document_regex_search(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.where(S.guarded(r"\bTHE\s+\w+ing\b")).select("doc_id", "lang")


# --- statistics --------------------------------------------------------------
def _dist(spark, d, dim: str, name: str) -> DataFrame:
    return B.distribution(A.conversations(spark, d)).where(F.col("dim") == dim).select(F.col("value").alias(name), "n")


@query
def dist_l1(spark, d):
    return _dist(spark, d, "L1", "L1")


@query
def dist_severity(spark, d):
    return _dist(spark, d, "severity", "severity")


@query
def dist_l2_exploded(spark, d):
    return _dist(spark, d, "L2", "L2")


@query
def trend_day(spark, d):
    return B.trend(A.conversations(spark, d), "day")


@query
def trend_hour(spark, d):
    return B.trend(A.conversations(spark, d), "hour")


@query
def trend_dense(spark, d):
    dense = B.dense_trend(A.conversations(spark, d))
    return dense.select("bucket", *[F.col(f"`{v}`").alias(f"c{i}") for i, v in enumerate(C.L1_VALUES)])


@query
def kpi_rates(spark, d):
    return B.rates(A.conversations(spark, d))


@query
def top_tags(spark, d):
    return B.top_tags(A.conversations(spark, d))


# --- ranking -----------------------------------------------------------------
def _candidates(spark, d):
    rows, conversations = _facts(spark, d)
    return R.candidates(conversations, rows, now_ms=A.NOW_MS)


def _groups(spark, d):
    return R.score_groups(_candidates(spark, d), now_ms=A.NOW_MS)


@query
def candidate_conversations(spark, d):
    return _candidates(spark, d).drop("group_id", "head_text")


@query
def signature_scores(spark, d):
    return _groups(spark, d).drop("versions", "last_ts_ms")


@query
def top5_signatures(spark, d):
    return R.top_groups(_groups(spark, d)).select(F.col("rank").cast("long").alias("rank"), "signature", "score", "representative_conversation_id")


@query
def version_histogram(spark, d):
    return _groups(spark, d).select("signature", M.versions_text(F.col("versions")).alias("versions"))


@query
def push_log(spark, d):
    rows = R.push_rows(R.top_groups(_groups(spark, d)), push_date="2024-01-30", created_at=1)
    return rows.select("push_date", F.col("rank").cast("long").alias("rank"), "signature", "score", "affected_versions", "representative_text", "is_empty")


@query
def push_markdown(spark, d):
    groups = _groups(spark, d)
    return R.push_message(R.top_groups(groups), R.push_scope(_candidates(spark, d), groups), push_date="2024-01-30")


# --- posts -------------------------------------------------------------------
def _posts(spark, d):
    """Stored posts, labels and hits."""
    store = A.post_store(spark, d)
    return tuple(store.table(spark, name) for name in ("posts", "labels", "hits"))


@query
def post_classify(spark, d):
    hits = A.post_hits(spark, d).select(F.concat("post_id", F.lit("-"), "searched_at", F.lit("-"), "search_rank").alias("post_id"), "text")
    return P.classify_posts(hits).select("post_id", "brand_focus", "sentiment", joined("topics"), "post_type", "risk_level")


@query
def post_relevance(spark, d):
    return A.post_hits(spark, d).groupBy("text").agg(F.max(P.relevant("text")).alias("relevant"), F.count("*").alias("n"))


@query
def post_upsert(spark, d):
    return A.posts(spark, d).select("post_id", "author_id", "author_verified", "created_at_raw", "text", "reposts_count", "first_seen_at", "last_seen_at")


@query
def post_time_parse(spark, d):
    return A.post_hits(spark, d).select("post_id", "search_rank", "searched_at", "created_at_raw", "created_at_ms")


@query
def post_list(spark, d):
    rows = P.list_posts(*_posts(spark, d), since="2024-01-02", until="2024-01-28", q="输入法", keyword="甲牌", limit=100)
    return rows.select("post_id", "brand_focus", "sentiment", joined("topics"), "event_ms", joined("keywords"))


@query
def post_keywords(spark, d):
    return P.keywords_of(P.new_hits(A.post_hits(spark, d))).select("post_id", joined("keywords"))


@query
def post_stats_dims(spark, d):
    posts, labels, _ = _posts(spark, d)
    return P.post_stats(P.filter_posts(posts, labels, since="2024-01-02", until="2024-01-28"))


@query
def post_trend(spark, d):
    posts, labels, _ = _posts(spark, d)
    return P.post_trend(P.filter_posts(posts, labels))


@query
def post_negative_rate(spark, d):
    posts, labels, _ = _posts(spark, d)
    return P.negative_rate(P.filter_posts(posts, labels))


@query
def post_high_risk(spark, d):
    return P.list_posts(*_posts(spark, d), risk_level="high", limit=10).select("post_id", "risk_level", "event_ms", joined("keywords"))


@query
def post_reply_labels(spark, d):
    replies = A.events(spark, d).select(F.concat(F.lit("p"), "event_id").alias("post_id"), A.pick(A.POST_REPLIES, F.col("event_id")).alias("reply"))
    good, _ = P.reply_labels(replies)
    return good.select("post_id", "brand_focus", "sentiment", joined("topics"), "post_type", "risk_level", "confidence", "reason", "label_source")


@query
def post_reply_counts(spark, d):
    return P.reply_counts(A.events(spark, d).select(F.col("event_id").alias("post_id"), A.pick(A.POST_REPLIES, F.col("event_id")).alias("reply")))


@query
def posts_to_label(spark, d):
    posts, labels, _ = _posts(spark, d)
    n = F.substring("post_id", 2, 20).cast("long")
    labels = labels.withColumn("label_source", F.when(n % 3 == 0, "llm").when(n % 3 == 1, P.HIDDEN).otherwise("rule"))
    return P.to_label(posts, labels, limit=50).select("post_id", "text")


@query
def latest_run(spark, d):
    return P.latest_run(A.runs(spark, d))


# --- reports -----------------------------------------------------------------
def _samples(spark, d):
    rows, conversations = _facts(spark, d)
    order = F.conv(F.substring("conversation_id", 1, 8), 16, 10).cast("long")
    snapshot = conversations.where("L1 = 'A.Bug'").select("conversation_id", order.alias("snapshot_order"), (order % 5).cast("int").alias("score"), F.lit("").alias("reason"))
    return RP.report_samples(snapshot, rows, conversations)


@query
def report_samples(spark, d):
    return RP.best_samples(_samples(spark, d)).select("conversation_id", "text", "platform", "appversion", "L1", "L2", "severity", "last_ts_ms", F.col("ai_score").cast("long").alias("ai_score"))


@query
def report_stats(spark, d):
    return RP.report_stats(_samples(spark, d))


@query
def report_range(spark, d):
    return RP.report_range(_samples(spark, d))


@query
def report_lines(spark, d):
    return RP.sample_lines(RP.best_samples(_samples(spark, d))).select("line")


def _by_score(spark, d) -> DataFrame:
    scores = settle(_samples(spark, d).select("conversation_id", "last_ts_ms", "ai_score"), "scores")  # a sort by ranges reads its rows twice
    return B.by_score(scores, F.nullif(F.col("ai_score"), F.lit(0))).select("conversation_id", "last_ts_ms", F.col("ai_score").cast("long").alias("ai_score"))


@query
def score_sort(spark, d):
    return _by_score(spark, d)


def overlap_scorer(query: str, batch: list[tuple[str, str]]) -> list[dict]:
    """Stands for a model: 3 if the text holds the query, 1 if it holds none of its characters, else 2."""
    return [{"score": 3 if query in text else 2 if set(query) & set(text) else 1, "reason": "overlap"} for _, text in batch]


@query
def relevance_batches(spark, d):
    texts = RP.conversation_texts(_facts(spark, d)[0])
    return RP.score_conversations(texts, "卡顿", overlap_scorer).select("conversation_id", F.col("score").cast("long").alias("score"), "reason")


# --- streams -----------------------------------------------------------------
def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The rows of a stream that reads all there is and stops, written to the shared folder."""
    import uuid

    from feedlens.session import shared_root

    base = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
    else:
        run = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/log").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = A.table(spark, d, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_trend(spark, d):
    from feedlens.streaming.messages import stream_trend as trend

    out = _drained(spark, trend(_event_stream(spark, d)), "complete")
    return out.select(F.date_format("bucket_start", "yyyy-MM-dd").alias("bucket"), "event_type", "n")


@query
def stream_dedup_late(spark, d):
    from feedlens.streaming.messages import stream_dedup

    once = _event_stream(spark, d)
    return _drained(spark, stream_dedup(once.union(once), "event_id"), "append").select("event_id", "user_id", "event_type")


@query
def stream_sessions(spark, d):
    """Sessions of 12 hours, counted in complete mode; those of one user are told apart by their start."""
    from feedlens.streaming.messages import stream_sessions as sessions

    out = _drained(spark, sessions(_event_stream(spark, d), gap="12 hours"), "complete")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start_us"), "msg_count")
