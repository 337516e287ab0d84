"""Queries of upkeep: stores and their refresh, imports, jobs, runs, models, replay."""

from __future__ import annotations

import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import adapters as A
from feedlens import schemas
from feedlens.config import DAY_MS
from feedlens.functions import text as T
from feedlens.operators import browse as B
from feedlens.operators import filters as FL
from feedlens.operators import jobs as J
from feedlens.operators import posts as P
from feedlens.operators import ranking as R
from feedlens.operators import reports as RP
from feedlens.operators import search as S
from feedlens.operators import tagging
from feedlens.operators.calls import CallLog, score_once
from feedlens.operators.sessionize import sessionize_all
from feedlens.plans import intent as I
from feedlens.queries import END_MS, START_MS, _drained, _event_stream, _facts, _groups, _ids, _posts, _samples, joined, overlap_scorer, query
from feedlens.session import dealt, settle, shared_root
from feedlens.sources import merge as M
from feedlens.sources import messages as SM
from feedlens.sources.store import LabelStore
from feedlens.sources.windows import resolve_window, time_ms
from feedlens.sources.panes import Panes
from feedlens.streaming import conversations as SC
from feedlens.streaming import messages as ST

TIMES = ("2024-01-05 08:30:15", "2024-01-05T08:30", " 2024-01-06 ", "soon", None, "2024-01-07 09:05", "2024-01-08T10:00:01")
JSON_LISTS = ('["a","b"]', "broken", None, "[]", '{"a": 1}', '["ads", null]')
SCORE_REPLIES = ('```json\n[{"score": 3, "reason": "a"}, {"score": 9}]\n```', '{"score": "2", "reason": "b"}', "no", None, "[]", '```\n{"score": 1}\n```')
STATES = ("pending", "running", "failed", "succeeded")
TARGETS = ("running", "succeeded", "failed", "pending", "running")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


# --- stores ------------------------------------------------------------------
@query
def late_recompute(spark, d):
    """History without errors, then batches of errors (late), purchases (known) and errors again, by streams that deliver all of it twice."""
    m = A.messages(spark, d, kind=True)
    store = LabelStore(_folder(spark, "late"), gap_ms=A.LONG_GAP_MS).create(m.where("event_type <> 'error'").drop("event_type"))
    inbox = _folder(spark, "inbox")
    late = m.where("event_type = 'error'").drop("event_type")
    late.unionByName(late).unionByName(m.where("event_type = 'purchase'").drop("event_type")).write.parquet(inbox)
    for _ in range(2):
        stream = spark.readStream.schema(schemas.FEEDBACK).parquet(inbox)
        ST.run_available(stream, lambda batch, number: store.refresh(batch) and None, _folder(spark, "late-log")).awaitTermination()
    return store.conversations(spark).select("conversation_id", "L1", "L2", "severity", "confidence", "reason", "msg_count", "first_ts_ms", "last_ts_ms", "user_vid", "appversion")


@query
def change_feed(spark, d):
    """Conversations of all messages, as the store of those before errors came and the feed of what they changed give them."""
    m = A.messages(spark, d, kind=True)
    store = LabelStore(_folder(spark, "fed"), buckets=8, gap_ms=A.LONG_GAP_MS).create(m.where("event_type <> 'error'").drop("event_type"))
    log = store.log(spark)
    copied = store.conversations(spark)
    log.set_mark("copy", log.latest())
    store.refresh(m.where("event_type = 'error'").drop("event_type"))
    feed = settle(log.changes("conversations", "conversation_id", log.mark("copy")), "feed")  # read for its keys and for its rows
    kept = copied.join(feed.select("conversation_id"), "conversation_id", "left_anti").select(*copied.columns)
    now = kept.unionByName(feed.where("op <> 'delete'").drop("op"))
    return now.select("conversation_id", "L1", "L2", "severity", "confidence", "reason", "msg_count", "first_ts_ms", "last_ts_ms", "user_vid", "appversion")


# --- panes -------------------------------------------------------------------
PANE_DAYS = (0, 3, 10)


_PANES: dict[str, Panes] = {}


def _panes(spark, d) -> Panes:
    """Panes of the stored conversations, kept with them."""
    store = A.store(spark, d)
    if store.path not in _PANES:
        _PANES[store.path] = Panes(_folder(spark, "panes"), store)
    _PANES[store.path].refresh(spark)
    return _PANES[store.path]


@query
def pane_signatures(spark, d):
    """Signatures of the last seven days, from panes, as of several times."""
    panes, out = _panes(spark, d), None
    for back in PANE_DAYS:
        part = panes.signatures(spark, now_ms=A.NOW_MS - back * DAY_MS).select(F.lit(back).alias("days_back"), "signature", "score", "dup_count", "p0_count", "cross_version", "recent_24h", "representative_conversation_id")
        out = part if out is None else out.unionByName(part)
    return out


@query
def pane_trend(spark, d):
    return _panes(spark, d).trend(spark)


@query
def pane_sliding(spark, d):
    return _panes(spark, d).sliding(spark)


# --- kept calls ---------------------------------------------------------------
@query
def relevance_once(spark, d):
    """Relevance scores by kept calls, asked for a second time with a model that fails whatever it is asked."""
    texts = settle(RP.conversation_texts(_facts(spark, d)[0]).select("conversation_id", "text"), "texts")  # both times read them twice
    log = CallLog(_folder(spark, "calls"))

    def gone(question: str, batch: list[tuple[str, str]]) -> list[dict]:
        raise TimeoutError

    score_once(texts, log, "卡顿", overlap_scorer)
    return score_once(texts, log, "卡顿", gone).select("conversation_id", F.col("score").cast("long").alias("score"), "reason")


@query
def page_by_key(spark, d):
    """The third page of forty conversations, reached by keys."""
    store, after = A.store(spark, d), None
    for _ in range(3):
        found, after = store.page(spark, FL.Filters(L1="A.Bug"), after=after, limit=40)
        if after is None:
            break
    return found.select("conversation_id", "L1", "last_ts_ms", "platform", "preview_text")


@query
def replace_users(spark, d):
    """Users with an error get their conversations found again with the usual gap; the rows of all others stay."""
    m = A.messages(spark, d)
    users = A.events(spark, d).where("event_type = 'error'").select(F.concat(F.lit("u"), "user_id").alias("user_vid")).distinct()
    touched = m.join(users, "user_vid", "left_semi")
    return M.replace_keys(A.sessions(spark, d), sessionize_all(touched.select(*m.columns)), touched, "user_vid").select("feedback_id", "conversation_id")


@query
def backfill_conversations(spark, d):
    rows, conversations = _facts(spark, d)
    bare = conversations.withColumns({"service_vid": F.when(F.col("L1") == "A.Bug", F.col("service_vid")), "external_chat_url": F.lit("")})
    zero = rows.withColumn("external_chat_url", F.when(F.col("platform") == "iOS", F.concat(F.lit("kept:"), "user_vid")))
    return SM.backfill_conversations(bare, zero).select("conversation_id", "service_vid", "external_chat_url")


# --- imports and exports ------------------------------------------------------
@query
def json_round_trip(spark, d):
    """Responses landed as JSON lines, read again and flattened."""
    path = _folder(spark, "landed")
    M.write_json({"responses": A.responses(spark, d)}, path)
    rows = SM.flatten_responses(SM.read_responses(spark, f"{path}/responses"), start_ms=START_MS, end_ms=END_MS, channel="app")
    return rows.select("feedback_id", "ts_ms", "platform", "appversion", "user_vid", "service_vid", "external_chat_url", "device_name", "text", "tags")


@query
def import_isolated(spark, d):
    """Three tables: one with rows to refuse, one that can't be read, one without a fault."""
    labels = tagging.tag_messages(dealt(A.messages(spark, d).select("feedback_id", "text"))).withColumns({"extra": F.lit(1), "L1": F.when(F.col("rule_name") == "rule:suggest", "?").otherwise(F.col("L1"))})
    broken = A.posts(spark, d).withColumn("text", F.raise_error(F.lit("unreadable")))
    fine = F.lit(None).cast("string")
    tables = {"message_label": (labels, schemas.MESSAGE_LABEL, M.label_problem()), "post": (broken, schemas.POST, fine), "post_hit": (P.new_hits(A.post_hits(spark, d)), schemas.POST_HIT, fine)}
    out = M.import_tables(spark, tables, _folder(spark, "imported"))
    return out.select("table", "written", "refused", F.col("error").isNotNull().alias("failed"))


@query
def csv_file(spark, d):
    """The export written as one CSV file with a header, and read back; an empty text comes back as one."""
    rows, conversations = _facts(spark, d)
    items = B.list_conversations(conversations, rows, FL.Filters(L1="A.Bug"), limit=5000, most=5000)
    path = _folder(spark, "csv")
    M.write_csv(M.csv_rows(items), path)
    back = spark.read.csv(path, header=True)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return back.select("conversation_id", "L1", text("L2"), "severity", F.col("msg_count").cast("long").alias("msg_count"), "first_ts_human", text("user_vid"), text("appversion"), text("preview_text"))


@query
def push_delivered(spark, d):
    """Two days' pushes in the log, one of them marked as delivered."""
    top = R.top_groups(_groups(spark, d))
    days = [R.push_rows(top, push_date=day, created_at=1) for day in ("2024-01-29", "2024-01-30")]
    done = R.mark_delivered(days[0].unionByName(days[1]), push_date="2024-01-30", delivered_at=77)
    return done.select("push_date", F.col("rank").cast("long").alias("rank"), "signature", "delivered_at")


@query
def report_prompt(spark, d):
    return RP.report_prompt(_samples(spark, d), "闪退")


@query
def score_replies(spark, d):
    """Scores in a model's replies: objects and lists, in fences and bare, with scores that don't count."""
    e = A.events(spark, d).select("event_id", RP.parse_score(A.pick(SCORE_REPLIES, F.col("event_id"))).alias("found"))
    return e.select("event_id", F.posexplode_outer("found").alias("place", "x")).select("event_id", F.col("place").cast("long").alias("place"), F.col("x.score").cast("long").alias("score"), "x.reason")


@query
def mirror_tables(spark, d):
    path = _folder(spark, "mirror")
    hits = P.new_hits(A.post_hits(spark, d))
    M.mirror({"hits": hits, "runs": A.runs(spark, d)}, path)
    return spark.read.parquet(f"{path}/hits").select("post_id", "keyword", "query_name", "searched_at", "search_rank")


@query
def window_scan(spark, d):
    start, end = resolve_window(datetime.fromtimestamp(A.NOW_MS / 1000, UTC), last="48h")
    return A.messages(spark, d).where(F.col("ts_ms").between(start, end)).select("feedback_id", "ts_ms")


@query
def time_columns(spark, d):
    at = A.pick(TIMES, F.col("event_id"))
    return A.events(spark, d).select("event_id", time_ms(at).alias("from_ms"), time_ms(at, end_of_day=True).alias("to_ms"))


@query
def short_texts(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.ellipsis(F.col("text"), 40).alias("short"))


@query
def search_description(spark, d):
    """What a keyword search is called in a report, beside the number of messages that it fits."""
    groups = [S.KeywordGroup(["键盘", "卡顿"]), S.KeywordGroup(["闪退", "白屏"], "OR")]
    n = A.messages(spark, d).where(S.keyword_condition(groups)).agg(F.count("*").alias("n"))
    return n.select(F.lit(S.describe(groups, ["好用"])).alias("said"), "n")


# --- jobs, runs, days ---------------------------------------------------------
@query
def job_moves(spark, d):
    e = A.events(spark, d).select(F.concat(F.lit("j"), "event_id").alias("job_id"), "event_id", "k", "ts_ms")
    jobs = e.select("job_id", A.pick(STATES, F.col("k")).alias("status"), F.lit("old").alias("error_message"), F.lit(5).alias("sample_count"), F.lit(1).cast("long").alias("started_at"), F.lit(2).cast("long").alias("finished_at"))
    moves = e.select("job_id", A.pick(TARGETS, F.col("event_id")).alias("to"), F.col("ts_ms").alias("at"), F.lit("new").alias("error_message"), F.col("k").alias("sample_count"))
    done, refused = J.apply_moves(jobs, moves)
    no = refused.select("job_id", F.lit(True).alias("refused"))
    out = done.join(no, "job_id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
    return out.select("job_id", "status", "error_message", F.col("sample_count").cast("long").alias("sample_count"), "started_at", "finished_at", "refused")


@query
def newest_jobs(spark, d):
    jobs = A.events(spark, d).select(F.concat(F.lit("j"), "event_id").alias("job_id"), F.col("ts_ms").alias("created_at"), A.pick(STATES, F.col("k")).alias("status"))
    return P.newest(jobs, "created_at", "job_id", limit=30)


def _all_runs(spark, d):
    """Runs of purchases, after the insert of those of errors and of all purchases again."""
    runs = A.runs(spark, d).withColumn("error", F.lit(None).cast("string"))
    e = A.events(spark, d).where("event_type in ('error', 'purchase')")
    new = e.select(F.concat(F.lit("r"), "event_id").alias("run_id"), (F.col("ts_ms") * 1000 + F.col("event_id") % 1000).alias("started_at"), F.when(F.col("k") % 2 == 0, F.col("k")).alias("posts_found"), F.repeat(F.lit("x"), 600).alias("error"))
    return P.add_runs(runs, new)


@query
def crawl_runs(spark, d):
    return _all_runs(spark, d).select("run_id", "started_at", "posts_found", F.length("error").alias("error_chars"))


@query
def newest_runs(spark, d):
    return P.newest(_all_runs(spark, d), "started_at", "run_id", limit=500).select("run_id", "started_at")


def _day_log(spark, d):
    e = A.events(spark, d)
    return e.select(F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd").alias("day"), F.when((F.col("event_type") == "purchase") & (F.col("value") > 95), "succeeded").otherwise("failed").alias("status"))


@query
def open_days(spark, d):
    return SM.open_days(_day_log(spark, d), "2024-02-10", days=40)


@query
def replay_days(spark, d):
    """The open days run again; those whose date ends in 5 fail three times."""
    tried: list[str] = []

    def run(day: str) -> None:
        tried.append(day)
        if day.endswith("5"):
            raise TimeoutError(day)

    out = SM.replay(SM.open_days(_day_log(spark, d), "2024-02-10", days=40), run)
    times = spark.createDataFrame([(x, tried.count(x)) for x in dict.fromkeys(tried)], "day string, tries long")
    return out.join(times, "day")


# --- models -------------------------------------------------------------------
def reading_model(texts: list[str]) -> list[str]:
    """Stands for a model of messages: knows reading, fails at weather."""
    if any("天气" in t for t in texts):
        raise TimeoutError
    return ['{"L1": "C.咨询", "severity": "P3", "confidence": 0.5, "reason": "read"}' if "书" in t else "?" for t in texts]


@query
def model_labels(spark, d):
    m = A.messages(spark, d).select("feedback_id", "text")
    open_ = tagging.with_rule_label(m).where("rule_name is null").select("feedback_id", "text")
    told = open_.join(tagging.model_replies(open_, reading_model), "feedback_id")
    return tagging.tag_messages(told, reply=F.col("reply")).select("feedback_id", "L1", "confidence", "reason")


def post_model(texts: list[str]) -> list[str]:
    """Stands for a model of posts."""
    return [A.POST_REPLIES[0 if "卡" in t else 1 if "甜" in t else 3] for t in texts]


@query
def post_model_labels(spark, d):
    posts, _, _ = _posts(spark, d)
    good, bad = P.reply_labels(settle(tagging.model_replies(posts, post_model, key="post_id"), "replies"))  # both frames read what was asked once
    return good.select("post_id", "brand_focus", "label_source", "confidence").unionByName(bad.select("post_id", F.lit(None).cast("string").alias("brand_focus"), F.lit("failed").alias("label_source"), F.lit(None).cast("double").alias("confidence")))


@query
def progressive_scores(spark, d):
    parts = RP.score_in_turns(RP.conversation_texts(_facts(spark, d)[0]), "卡顿", overlap_scorer, turns=3)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out.select("conversation_id", F.col("score").cast("long").alias("score"), "reason")


@query
def complaint_search(spark, d):
    rows, conversations = _facts(spark, d)
    found, way = I.smart_search(conversations, rows, "很多投诉", ask_intent=lambda q: '```json\n{"must": [["投诉"], ["回复", "反馈"]]}\n```')
    return _ids(found).withColumn("way", F.lit(way))


@query
def model_pattern_search(spark, d):
    rows, conversations = _facts(spark, d)
    found, way = I.smart_search(conversations, rows, "奇怪", ask_intent=lambda q: "none", ask_patterns=lambda q: '{"groups": [{"patterns": ["频繁.*延迟", "(a+)+"]}, {"patterns": ["^GIF", "次都"], "logic": "OR"}]}')
    return _ids(found).withColumn("way", F.lit(way))


@query
def topic_question_search(spark, d):
    rows, conversations = _facts(spark, d)
    found, _ = I.smart_search(conversations, rows, "皮肤和主题 iOS端", FL.Filters(severity="P3"))
    return _ids(found)


# --- posts --------------------------------------------------------------------
@query
def post_list_topic(spark, d):
    rows = P.list_posts(*_posts(spark, d), topic="bug", sentiment="negative", limit=100)
    return rows.select("post_id", joined("topics"), "event_ms")


@query
def stored_posts(spark, d):
    e = A.events(spark, d).select(F.col("event_id").alias("post_id"), A.pick(JSON_LISTS, F.col("event_id")).alias("pic_urls_json"), A.pick(JSON_LISTS, F.col("event_id") + 1).alias("topics_json"))
    return P.stored_items(e).select("post_id", joined("pic_urls"), joined("topics"))


# --- streams ------------------------------------------------------------------
@query
def stream_labels(spark, d):
    """Conversation labels by a stream of messages that starts twice, the second time for late ones and repeats."""
    m = A.messages(spark, d, kind=True)
    inbox, out, log = (_folder(spark, name) for name in ("inbox", "changes", "changes-log"))
    for k, part in enumerate((m.where("event_type <> 'error'"), m.where("event_type in ('error', 'purchase')"))):
        part.drop("event_type").write.parquet(f"{inbox}/part-{k}")
        stream = spark.readStream.schema(schemas.FEEDBACK).option("recursiveFileLookup", "true").parquet(inbox)
        SC.keep_changes(SC.conversation_changes(stream, gap_ms=A.LONG_GAP_MS, late="60 days"), out, log).awaitTermination()
    now = SC.current(spark.read.parquet(out))
    return now.select("conversation_id", "L1", "L2", "severity", "confidence", "reason", "msg_count", "first_ts_ms", "last_ts_ms", "user_vid", "appversion")


@query
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(spark, ST.stream_trend(_event_stream(spark, d), bucket="7 days", slide="1 day"), "complete")
    return out.select(F.date_format("bucket_start", "yyyy-MM-dd").alias("bucket"), "event_type", "n")


@query
def rules_from_file(spark, d):
    """The tagger with rules of a JSON file, which the driver reads."""
    import json

    from feedlens.config import load_tag_rules

    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False, encoding="utf-8") as f:
        json.dump({"p0": ["闪退", "^顶$"], "bug": ["卡.?顿"]}, f)
    found = tagging.with_rule_label(A.messages(spark, d).select("feedback_id", "text"), load_tag_rules(f.name))
    return found.where("L1 = 'A.Bug'").select("feedback_id", "severity", "reason")
