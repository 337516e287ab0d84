"""Social posts: labels by rule, merging of search hits, lists and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens.functions import text as T
from feedlens.operators.filters import check_page
from feedlens.session import dealt
from feedlens.sources.merge import insert_ignore
from feedlens.sources.windows import parse_time

FOCUS = ("own", "rival", "comparison", "other")
SENTIMENTS = ("positive", "neutral", "negative", "mixed")
TOPICS = (*C.TOPIC_TERMS, "other")
POST_TYPES = ("complaint", "help", "recommendation", "review", "reshare", "news_discussion", "other")
RISKS = ("normal", "watch", "high")
HIDDEN = "llm_hidden"


def _low(column: str) -> str:
    """The name of a column's text in lower case, which is made once for all word lists."""
    return f"{column}_low"


def _says(column: str, terms) -> str:
    return T.sql_contains(_low(column), [t.lower() for t in terms])


def _near(brands: C.Brands) -> str:
    return brands.own_near + ".{0,12}(?:" + "|".join(brands.own_what) + ")"


def _mentions(column: str, brands: C.Brands) -> tuple[str, str]:
    """SQL text of (own product, rival product) is meant: by name, or by a short name beside a word of the field."""
    near = f"rlike({column}, {T.literal(_near(brands))})"
    return f"({_says(column, brands.own)} OR {near})", f"({_says(column, brands.rival)} AND {_says(column, brands.rival_context)})"


def relevant(column: str = "text", brands: C.Brands = C.Brands()) -> Column:
    """True if a post is about one of the products; a null text is not."""
    near, said = F.col(column).rlike(_near(brands)), lambda terms: T.contains_any(F.lower(column), [t.lower() for t in terms])
    return F.coalesce(said(brands.own) | near | (said(brands.rival) & said(brands.rival_context)), F.lit(False))


def with_post_label(posts: DataFrame, brands: C.Brands = C.Brands()) -> DataFrame:
    """Adds focus, sentiment, topics, type and risk of a post's text by rule; a null text counts as empty."""
    s = "_s"
    own, rival = _mentions(s, brands)
    flags = {"_own": own, "_rival": rival, "_good": _says(s, C.POSITIVE_TERMS), "_bad": _says(s, C.NEGATIVE_TERMS)}
    base = T.once(T.once(posts, **{s: T.strip(F.coalesce("text", F.lit("")))}), **{_low(s): F.lower(s)})
    base = base.withColumns({k: F.expr(v) for k, v in flags.items()})
    has = {t: _says(s, words) for t, words in C.TOPIC_TERMS.items()}
    has["feature_comparison"] = f"(_own AND _rival) OR {has['feature_comparison']}"
    topics = base.withColumn("_t", F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for t, c in has.items()) + "))"))
    kinds = " ".join(f"WHEN {_says(s, words)} THEN '{t}'" for t, words in C.POST_TYPE_TERMS.items())
    return topics.withColumns({
        "brand_focus": F.expr("CASE WHEN _own AND _rival THEN 'comparison' WHEN _rival THEN 'rival' WHEN _own THEN 'own' ELSE 'other' END"),
        "sentiment": F.expr("CASE WHEN _good AND _bad THEN 'mixed' WHEN _good THEN 'positive' WHEN _bad THEN 'negative' ELSE 'neutral' END"),
        "topics": F.expr("CASE WHEN size(_t) > 0 THEN _t ELSE array('other') END"),
        "post_type": F.expr(f"CASE {kinds} WHEN _bad AND NOT _good THEN 'complaint' ELSE 'other' END"),
        "risk_level": F.expr(f"CASE WHEN {_says(s, C.HIGH_RISK_TERMS)} THEN 'high' WHEN _bad AND NOT _good AND arrays_overlap(_t, array('privacy', 'ads', 'bug')) THEN 'watch' ELSE 'normal' END"),
        "confidence": F.lit(0.7), "reason": F.lit("规则命中：品牌、情绪、话题和风险关键词"), "label_source": F.lit("rule"),
    }).drop(s, _low(s), "_t", *flags)


def classify_posts(posts: DataFrame, brands: C.Brands = C.Brands(), *, labeled_at: int = 0) -> DataFrame:
    return with_post_label(posts.select("post_id", "text"), brands).drop("text").withColumn("labeled_at", F.lit(labeled_at).cast("long"))


def written_at(raw: Column, seen_at: Column, *, zone: str = "Asia/Shanghai") -> Column:
    """Milliseconds of a displayed time: today's hour, minutes ago, a day of the year, a full date; null if it is none.

    ``seen_at`` are the seconds at which it was displayed. A day of the year that
    lies more than a day ahead of them belongs to the year before. Parts that are
    no time (hour 25, 31 February) give null.
    """
    s = T.strip(raw)
    base = F.from_utc_timestamp(F.timestamp_seconds(seen_at), zone).cast("timestamp_ntz")
    part = lambda shape, k: F.regexp_extract(s, shape, k).try_cast("int")
    clock = lambda y, mo, d, h, mi: F.when(y > 0, F.try_make_timestamp_ntz(y, mo, d, h, mi, F.lit(0)))
    today, ago, day, full = r"^今天\s*(\d{1,2}):(\d{2})$", r"^(\d+)\s*分钟前$", r"^(\d{1,2})月(\d{1,2})日\s+(\d{1,2}):(\d{2})$", r"^(\d{4})年(\d{1,2})月(\d{1,2})日\s+(\d{1,2}):(\d{2})$"
    of_day = lambda year: clock(year, part(day, 1), part(day, 2), part(day, 3), part(day, 4))
    this_year = of_day(F.year(base))
    local = (
        F.when(s.rlike(today), clock(F.year(base), F.month(base), F.day(base), part(today, 1), part(today, 2)))
        .when(s.rlike(ago), base - F.make_dt_interval(mins=F.regexp_extract(s, ago, 1).try_cast("int")))
        .when(s.rlike(day), F.when(this_year > base + F.expr("interval 1 day"), of_day(F.year(base) - 1)).otherwise(this_year))
        .when(s.rlike(full), clock(part(full, 1), part(full, 2), part(full, 3), part(full, 4), part(full, 5)))
        .otherwise(F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm"))).cast("timestamp_ntz"))
    )
    return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), zone))


def event_ms() -> Column:
    return F.coalesce("created_at_ms", F.col("last_seen_at") * 1000)


def merge_posts(existing: DataFrame, found: DataFrame, *, skip_irrelevant: bool = True, brands: C.Brands = C.Brands()) -> DataFrame:
    """Posts after a crawl.

    ``found`` are search hits (post columns, searched_at): of each post the last
    hit's content is kept, with the first time it was ever seen. Posts that aren't
    about the products are skipped.
    """
    content = [c for c in existing.columns if c not in ("first_seen_at", "last_seen_at")]
    hits = found.where(relevant("text", brands)) if skip_irrelevant else found
    hits = hits.where(F.coalesce("post_id", F.lit("")) != "").select(*content, F.col("searched_at").alias("first_seen_at"), F.col("searched_at").alias("last_seen_at"), F.lit(1).alias("_new"))
    both = existing.select(*content, "first_seen_at", "last_seen_at", F.lit(0).alias("_new")).unionByName(hits)
    newest = F.max(F.struct(F.col("last_seen_at").alias("_at"), "_new", *[c for c in content if c != "post_id"]))  # of equal times the greatest content: any order of rows gives the same
    out = both.groupBy("post_id").agg(newest.alias("_row"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return out.select("post_id", "_row.*", "first_seen_at", "last_seen_at").select(*existing.columns)


def new_hits(found: DataFrame) -> DataFrame:
    """Rows for the append-only table of hits; a hit without a query name is named by its keyword."""
    return found.select("post_id", "keyword", F.coalesce(F.nullif(F.col("query_name"), F.lit("")), F.col("keyword")).alias("query_name"), "searched_at", "search_rank", "source_mode")


def keywords_of(hits: DataFrame) -> DataFrame:
    """(post_id, keywords): different query names in the order in which they first found the post.

    Names are reduced to their first time before anything is collected.
    """
    first = hits.where(F.coalesce("query_name", F.lit("")) != "").groupBy("post_id", "query_name").agg(F.min("searched_at").alias("at"))
    return first.groupBy("post_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "query_name"))), lambda x: x["query_name"]).alias("keywords"))


def list_posts(posts: DataFrame, labels: DataFrame, hits: DataFrame, *, since: str | None = None, until: str | None = None, q: str | None = None, brand_focus: str | None = None, sentiment: str | None = None, topic: str | None = None, post_type: str | None = None, risk_level: str | None = None, keyword: str | None = None, limit: int = 50, offset: int = 0, include_hidden: bool = False) -> DataFrame:
    """One page of posts with labels and keywords, newest first, equal times by falling id."""
    check_page(limit, offset)
    rows = filter_posts(posts, labels, hits, since=since, until=until, q=q, brand_focus=brand_focus, sentiment=sentiment, topic=topic, post_type=post_type, risk_level=risk_level, keyword=keyword, include_hidden=include_hidden)
    cut = rows.withColumn("event_ms", event_ms()).orderBy(F.desc("event_ms"), F.desc("post_id")).offset(offset).limit(limit)
    mine = hits.join(cut.select("post_id"), "post_id", "left_semi")
    return cut.join(keywords_of(mine), "post_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def filter_posts(posts: DataFrame, labels: DataFrame, hits: DataFrame | None = None, *, since: str | None = None, until: str | None = None, q: str | None = None, keyword: str | None = None, topic: str | None = None, include_hidden: bool = False, **equal: str | None) -> DataFrame:
    """Labelled posts that pass; ``equal`` names label columns. Values outside the enumerations raise."""
    allowed = {"brand_focus": FOCUS, "sentiment": SENTIMENTS, "post_type": POST_TYPES, "risk_level": RISKS}
    for name, value in equal.items():
        if name not in allowed or value is not None and value not in allowed[name]:
            raise ValueError(f"{name}: {value}")
    if topic is not None and topic not in TOPICS:
        raise ValueError(f"topic: {topic}")
    lab = labels.select("post_id", "brand_focus", "sentiment", "topics", "post_type", "risk_level", "confidence", "reason", "label_source")
    lab = lab.where(T.all_of([F.col(c) == v for c, v in equal.items() if v is not None] + ([F.array_contains("topics", topic)] if topic else []) + ([] if include_hidden else [F.col("label_source") != HIDDEN])))
    out = posts
    if (ms := parse_time(since)) is not None:
        out = out.where(event_ms() >= ms)
    if (ms := parse_time(until, end_of_day=True)) is not None:
        out = out.where(event_ms() <= ms)
    if q:
        out = out.where(T.contains_fold(F.col("text"), q))
    out = out.join(lab, "post_id")
    if keyword:
        out = out.join(hits.where((F.col("keyword") == keyword) | (F.col("query_name") == keyword)).select("post_id"), "post_id", "left_semi")
    return out


def post_stats(rows: DataFrame) -> DataFrame:
    """(dim, value, n) of labelled posts for focus, sentiment, risk, each topic, and the total, from one scan."""
    one = lambda dim, c: F.array(F.struct(F.lit(dim).alias("dim"), c.alias("value")))
    every = F.concat(
        one("total", F.lit("posts")), *[one(d, F.col(d)) for d in ("brand_focus", "sentiment", "risk_level")],
        F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.struct(F.lit("topic").alias("dim"), t.alias("value"))),
    )
    return rows.select(F.explode(every).alias("e")).groupBy("e.dim", "e.value").agg(F.count("*").alias("n"))


def post_trend(rows: DataFrame) -> DataFrame:
    """(bucket, total, own, rival, comparison) per day; posts of another focus count in the total alone."""
    counts = [F.count_if(F.col("brand_focus") == f).alias(f) for f in FOCUS[:3]]
    return rows.where(F.coalesce(event_ms(), F.lit(0)) != 0).groupBy(T.time_bucket(event_ms(), "day").alias("bucket")).agg(F.count("*").alias("total"), *counts)


def negative_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("posts"), T.percent(F.count_if(F.col("sentiment") == "negative"), F.count("*")).alias("negative"))


def stored_items(rows: DataFrame) -> DataFrame:
    """Posts as they are stored, with JSON text in pic_urls_json and topics_json, as items with arrays.

    Text that is null or no JSON array of texts counts as an empty list, and for topics as none but 'other'.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.filter(F.coalesce(F.from_json(c, "array<string>"), none), lambda x: x.isNotNull())
    topics = listed("topics_json")
    return rows.withColumns({"pic_urls": listed("pic_urls_json"), "topics": F.when(F.size(topics) > 0, topics).otherwise(F.array(F.lit("other")))}).drop("pic_urls_json", "topics_json")


RUN_ERROR_CHARS = 500


def add_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """The table of crawl runs after an insert: a run that is there stays as it is; counts that are null become 0, errors are cut."""
    rows = new.withColumn("posts_found", F.coalesce("posts_found", F.lit(0)).cast("long")).withColumn("error", F.substring("error", 1, RUN_ERROR_CHARS))
    return runs.unionByName(insert_ignore(runs, rows.select(*runs.columns), "run_id", order="started_at"))


def newest(rows: DataFrame, by: str, key: str, *, limit: int = 20, most: int = 100) -> DataFrame:
    """The newest runs or jobs; equal times by key. The limit is brought into 1..``most``."""
    return rows.orderBy(F.desc(by), key).limit(min(max(limit, 1), most))


def latest_run(runs: DataFrame) -> DataFrame:
    """The crawl run that started last, as one row; none without runs."""
    return runs.agg(F.max_by(F.struct(*runs.columns), "started_at").alias("r")).where("r is not null").select("r.*")


def to_label(posts: DataFrame, labels: DataFrame, *, limit: int = 50) -> DataFrame:
    """Posts that no model has labelled yet, newest first."""
    rows = posts.join(labels.where(~F.col("label_source").isin("llm", HIDDEN)).select("post_id"), "post_id", "left_semi")
    return rows.orderBy(event_ms().desc(), F.desc("post_id")).limit(limit)


REPLY = "is_relevant string, relevance_reason string, brand_focus string, sentiment string, topics string, post_type string, risk_level string, summary string, reason string, confidence string"


def with_parsed_reply(replies: DataFrame) -> DataFrame:
    """Adds ``p``, the struct of a model's label of a post, with ``problem`` set where it can't be used.

    Enumerations are strict, truth values may be words, the confidence is clamped
    or null, topics are cut down to known ones. Each step is a generated column, so that a reply
    is parsed once, however many of its values are asked for. The rows are dealt over all cores first: parsing costs more than an exchange.
    """
    text = T.strip(F.coalesce("reply", F.lit("")))
    rows = T.once(dealt(replies), _text=text)
    fenced = F.nullif(F.regexp_extract("_text", r"(?is)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    rows = T.once(rows, _body=T.strip(F.coalesce(fenced, "_text")))
    rows = T.once(rows, _o=F.from_json("_body", REPLY))
    said = {c: T.strip(F.coalesce(F.col(f"_o.{c}"), F.lit(""))) for c in ("is_relevant", "brand_focus", "sentiment", "post_type", "risk_level", "summary", "reason", "relevance_reason")}
    listed = F.coalesce(F.from_json("_o.topics", "array<string>"), F.array("_o.topics"))
    rows = T.once(rows, _said=F.struct(*[c.alias(name) for name, c in said.items()], listed.alias("topics"), F.nullif("_o.confidence", F.lit("")).alias("sure")))
    word, sure = F.lower("_said.is_relevant"), F.col("_said.sure")
    truth = F.when(word.isin("true", "yes", "1"), True).when(word.isin("false", "no", "0"), False)
    topics = F.array_distinct(F.filter(F.transform("_said.topics", T.strip), lambda t: t.isin(*TOPICS)))
    rows = T.once(rows, _more=F.struct(truth.alias("truth"), topics.alias("topics"), sure.try_cast("double").alias("sure")))
    problem = F.coalesce(
        F.when(F.col("_o").isNull() | ~F.col("_body").startswith("{"), "json"), F.when(F.col("_more.truth").isNull(), "is_relevant"),
        *[F.when(~F.col(f"_said.{c}").isin(*allowed), c) for c, allowed in (("brand_focus", FOCUS), ("sentiment", SENTIMENTS), ("post_type", POST_TYPES), ("risk_level", RISKS))],
        F.when(sure.isNotNull() & F.col("_more.sure").isNull(), "confidence"),
    )
    found = F.struct(
        problem.alias("problem"), F.col("_more.truth").alias("is_relevant"), "_said.brand_focus", "_said.sentiment",
        F.when(F.size("_more.topics") > 0, F.col("_more.topics")).otherwise(F.array(F.lit("other"))).alias("topics"), "_said.post_type", "_said.risk_level", "_said.summary",
        F.coalesce(F.nullif("_said.reason", F.lit("")), "_said.relevance_reason").alias("reason"), F.when(sure.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_more.sure"))).alias("confidence"),
    )
    return T.once(rows, p=found).select(*replies.columns, "p")


def reply_labels(replies: DataFrame, *, labeled_at: int = 0) -> tuple[DataFrame, DataFrame]:
    """(post labels, replies set aside) from (post_id, reply); what the model finds irrelevant is hidden."""
    parsed = with_parsed_reply(replies)
    reason = F.array_join(F.filter(F.array("p.summary", "p.reason"), lambda x: x != ""), "\n\n")
    good = parsed.where("p.problem is null").select(
        "post_id", "p.brand_focus", "p.sentiment", "p.topics", "p.post_type", "p.risk_level", "p.confidence", reason.alias("reason"),
        F.when(F.col("p.is_relevant"), "llm").otherwise(HIDDEN).alias("label_source"), F.lit(labeled_at).cast("long").alias("labeled_at"),
    )
    return good, parsed.where("p.problem is not null").select("post_id", "reply", "p.problem")


def reply_counts(replies: DataFrame) -> DataFrame:
    """One row: seen, labeled, hidden, failed."""
    rows = with_parsed_reply(replies.select("reply"))
    good = F.col("p.problem").isNull()
    return rows.agg(F.count("*").alias("seen"), F.count_if(good).alias("labeled"), F.count_if(good & ~F.col("p.is_relevant")).alias("hidden"), F.count_if(~good).alias("failed"))
