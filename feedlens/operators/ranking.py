"""Recurring bugs: candidates, signatures, scores, the daily top list and its message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens import schemas
from feedlens.functions import text as T
from feedlens.sources.merge import versions_text

TOP = 5
#: Characters that stand for a conversation without a surest message.
HEAD_CHARS = 100


def _joined(part: Column) -> Column:
    """The texts of structs (msg_seq, text) in their order; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), " || ")


def candidates(conversations: DataFrame, messages: DataFrame, labels: DataFrame | None = None, *, now_ms: int, days: int = 7, rules: C.SignatureRules = C.SignatureRules()) -> DataFrame:
    """Serious, sure and recent bug conversations with their whole text and their surest message.

    All comes from one aggregation over the messages of the candidates. group_id
    is the first signature group that any message has, head_text begins the text
    by its first messages: what reads these alone never gathers a whole
    conversation, however long. Without ``labels`` the messages hold their own confidence.
    """
    bugs = conversations.where((F.col("L1") == "A.Bug") & F.col("severity").isin("P0", "P1") & (F.col("confidence") >= 0.7) & (F.col("last_ts_ms") >= now_ms - days * C.DAY_MS))
    mine = messages.join(bugs.select("conversation_id"), "conversation_id", "left_semi")
    mine = mine.withColumn("_sure", F.col("confidence")) if labels is None else mine.join(labels.select("feedback_id", F.col("confidence").alias("_sure")), "feedback_id", "left")
    said = mine.withColumn("_group", F.expr(_group_number("text", rules))).groupBy("conversation_id").agg(
        _joined(F.struct("msg_seq", "text")).alias("full_text"),
        _joined(F.when(F.col("msg_seq") < HEAD_CHARS, F.struct("msg_seq", F.substring("text", 1, HEAD_CHARS).alias("text")))).alias("head_text"),
        F.min("_group").alias("_group"),
        F.max_by(F.struct("feedback_id", "text"), F.when(F.col("_sure").isNotNull(), F.struct("_sure", -F.col("msg_seq")))).alias("_top"),
    )
    out = bugs.select("conversation_id", "L1", F.coalesce("L2", F.lit("")).alias("L2"), "severity", "confidence", "appversion", "last_ts_ms").join(said, "conversation_id", "left")
    return out.select(
        "conversation_id", "L1", "L2", "severity", "confidence", "appversion", "last_ts_ms", F.coalesce("full_text", F.lit("")).alias("full_text"),
        F.coalesce("_top.text", F.lit("")).alias("top_conf_text"), F.coalesce("_top.feedback_id", F.lit("")).alias("top_conf_feedback_id"),
        F.get(F.array(*map(F.lit, rules.priority)), F.col("_group") - 1).alias("group_id"), F.substring(F.coalesce("head_text", F.lit("")), 1, HEAD_CHARS).alias("head_text"),
    )


def _group_number(column: str, rules: C.SignatureRules) -> str:
    """SQL text: the place, from 1, of the first group by priority of which the text holds a word; null for none."""
    return "CASE " + " ".join(f"WHEN {T.sql_contains(column, rules.groups[g])} THEN {k}" for k, g in enumerate(rules.priority, 1)) + " END"


def signature_group(column: str = "full_text", rules: C.SignatureRules = C.SignatureRules()) -> Column:
    """The first specific group, by priority, of which the text holds a word; null if only generic words or none occur."""
    return F.expr("CASE " + " ".join(f"WHEN {T.sql_contains(column, rules.groups[g])} THEN {T.literal(g)}" for g in rules.priority) + " END")


def signatures(rows: DataFrame, rules: C.SignatureRules = C.SignatureRules()) -> DataFrame:
    """Candidates with group_id (their own, or that of full_text), primary_l2 and major_version; those without a group are dropped."""
    own = F.col("group_id") if "group_id" in rows.columns else signature_group("full_text", rules)
    named = rows.withColumns({"group_id": own, "primary_l2": T.primary_tag(F.col("L2")), "major_version": T.major_version(F.col("appversion"))})
    return named.where("group_id is not null")


SIGNATURE = ("group_id", "primary_l2", "major_version")


def signature_rows(rows: DataFrame, rules: C.SignatureRules = C.SignatureRules()) -> DataFrame:
    """Candidates as what a signature is counted from: its parts, the version v, severity, and what is shown of the conversation."""
    known = F.coalesce(F.nullif(F.col("appversion"), F.lit("")), F.lit("_unknown"))
    head = F.col("head_text") if "head_text" in rows.columns else F.substring("full_text", 1, HEAD_CHARS)
    text = F.when(F.col("top_conf_text") != "", F.col("top_conf_text")).otherwise(head)
    return signatures(rows, rules).select(*SIGNATURE, known.alias("v"), "severity", "confidence", "last_ts_ms", "conversation_id", text.alias("shown_text"), "top_conf_feedback_id")


def signature_partials(rows: DataFrame, *more: str) -> DataFrame:
    """Counts of ``signature_rows`` for each signature and version (and ``more`` columns): partials that ``merge_partials`` adds up.

    Of equally sure conversations the newest is the best one.
    """
    shown = F.struct(F.col("shown_text").alias("text"), "conversation_id", "top_conf_feedback_id")
    sure = F.struct("confidence", "last_ts_ms", "conversation_id")
    return rows.groupBy(*more, *SIGNATURE, "v").agg(
        F.count("*").alias("c"), F.count_if(F.col("severity") == "P0").alias("p0"), F.max("last_ts_ms").alias("last"), F.max(F.struct(sure.alias("sure"), shown.alias("shown"))).alias("best")
    )


def merge_partials(partials: DataFrame, *, now_ms: int, rules: C.SignatureRules = C.SignatureRules()) -> DataFrame:
    """One scored row per signature from its partials, of one or of several parts of the time."""
    per = partials.groupBy(*SIGNATURE, "v").agg(F.sum("c").alias("c"), F.sum("p0").alias("p0"), F.max("last").alias("last"), F.max("best").alias("best"))
    out = per.groupBy(*SIGNATURE).agg(
        F.sum("c").alias("dup_count"), F.sum("p0").alias("p0_count"), (F.count_if(F.col("v") != "_unknown") > 1).cast("int").alias("cross_version"),
        (F.max("last") >= now_ms - C.DAY_MS).cast("int").alias("recent_24h"), F.max("last").alias("last_ts_ms"), F.collect_list(F.struct("v", "c")).alias("versions"), F.max("best").alias("best"),
    )
    w = rules.weights
    score = F.col("dup_count") * w["dup"] + F.col("p0_count") * w["p0"] + F.col("cross_version") * w["cross"] + F.col("recent_24h") * w["recent"]
    return out.select(
        F.concat_ws("|", *SIGNATURE).alias("signature"), *SIGNATURE, score.alias("score"), "dup_count", "p0_count", "cross_version", "recent_24h", "last_ts_ms", "versions",
        F.col("best.shown.text").alias("representative_text"), F.col("best.shown.conversation_id").alias("representative_conversation_id"), F.col("best.shown.top_conf_feedback_id").alias("representative_feedback_id"),
    )


def score_groups(rows: DataFrame, *, now_ms: int, rules: C.SignatureRules = C.SignatureRules()) -> DataFrame:
    """One scored row per signature of candidates.

    Versions are counted first, so a signature's state is one entry for each
    version however many conversations it has.
    """
    return merge_partials(signature_partials(signature_rows(rows, rules)), now_ms=now_ms, rules=rules)


def top_groups(groups: DataFrame, n: int = TOP) -> DataFrame:
    """The best groups with their rank; of equal scores the group with the newest conversation comes first."""
    order = F.struct(-F.col("score"), -F.col("last_ts_ms"), "signature")
    best = groups.orderBy(F.desc("score"), F.desc("last_ts_ms"), "signature").limit(n)
    ranked = best.groupBy().agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*groups.columns).alias("g")))).alias("all"))  # n rows at most
    return ranked.select(F.posexplode("all").alias("pos", "e")).select((F.col("pos") + 1).alias("rank"), "e.g.*")


def push_rows(top: DataFrame, *, push_date: str, created_at: int) -> DataFrame:
    """Rows for the log of pushes; one placeholder of rank 0 if there is no group."""
    rows = top.select(
        F.lit(push_date).alias("push_date"), "rank", "signature", "group_id", "primary_l2", "major_version", "representative_conversation_id", "representative_feedback_id", "score",
        "dup_count", "p0_count", "cross_version", versions_text(F.col("versions")).alias("affected_versions"), "representative_text", F.lit(created_at).alias("created_at"), F.lit(0).alias("is_empty"),
    )
    none = top.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(push_date).alias("push_date"), F.lit(0).alias("rank"), F.lit(created_at).alias("created_at"), F.lit(1).alias("is_empty"))
    return schemas.conform(rows, schemas.PUSH_LOG).unionByName(schemas.conform(none, schemas.PUSH_LOG))


def mark_delivered(log: DataFrame, *, push_date: str, delivered_at: int) -> DataFrame:
    return log.withColumn("delivered_at", F.when(F.col("push_date") == push_date, F.lit(delivered_at).cast("long")).otherwise(F.col("delivered_at")))


def push_message(top: DataFrame, scope: DataFrame, *, push_date: str, names: dict[str, str] | None = None) -> DataFrame:
    """One row with the Markdown of the day; ``scope`` is one row (scanned, groups)."""
    shown = F.create_map(*[F.lit(x) for pair in (names or C.DISPLAY_NAMES).items() for x in pair])
    block = F.concat(
        F.lit("**"), F.col("rank").cast("string"), F.lit(". "), F.when(F.col("p0_count") > 0, "[P0]").otherwise("[P1]"), F.lit(" "), F.coalesce(shown[F.col("group_id")], F.col("group_id")), F.lit(" · "), F.col("primary_l2"),
        F.lit(" · "), F.when(F.col("cross_version") == 1, "跨版本").otherwise(F.concat("major_version", F.lit(" 版本"))), F.lit("** · 重复 "), F.col("dup_count").cast("string"), F.lit(" 次\n> \""),
        F.coalesce(F.nullif(F.col("representative_text"), F.lit("")), F.lit("（无代表文本）")), F.lit("\"\n> 涉及版本："), versions_text(F.col("versions"), pair=" (", sep=", ", close=")"),
    )
    body = top.select("rank", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    window = F.concat(F.lit("> 数据窗口：过去 7 天 · 扫描 "), F.col("scanned").cast("string"), F.lit(" 个 Bug 会话"))
    some = F.concat(F.lit(f"## 📊 今日 Top Bug 候选 · {push_date}\n\n"), window, F.lit(" · 命中 "), F.col("groups").cast("string"), F.lit(" 个签名\n\n---\n\n"), F.col("body"))
    return scope.crossJoin(body).select(F.when(F.col("body") == "", F.concat(F.lit(f"## 📊 今日无 Top Bug · {push_date}\n\n"), window)).otherwise(some).alias("markdown"))  # one row each


def push_scope(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: candidates scanned, and signatures before the cut."""
    return rows.agg(F.count("*").alias("scanned")).crossJoin(groups.agg(F.count("*").alias("groups")))  # one row each
