"""Report samples and statistics, and relevance scores from a model."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.session import settle

TEXT_CHARS = 500
MAX_SAMPLES = 80


def conversation_texts(messages: DataFrame) -> DataFrame:
    """(conversation_id, text, platform, appversion): messages in order, joined and cut to 500 characters; the rest from the first message.

    Only the first 500 characters of the first 500 messages can show, so no more are collected.
    """
    early = messages.where(F.col("msg_seq") < TEXT_CHARS).select("conversation_id", "msg_seq", F.substring(F.coalesce("text", F.lit("")), 1, TEXT_CHARS).alias("text"), "platform", "appversion")
    out = early.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_seq", "text"))), lambda x: x["text"]), " | ").alias("text"), F.min_by(F.struct("platform", "appversion"), "msg_seq").alias("_first")
    )
    return out.select("conversation_id", F.substring("text", 1, TEXT_CHARS).alias("text"), F.coalesce("_first.platform", F.lit("")).alias("platform"), F.coalesce("_first.appversion", F.lit("")).alias("appversion"))


def report_samples(snapshot: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Texts and labels of a snapshot (conversation_id, snapshot_order, score, reason).

    Conversations without messages are left out; a score that isn't 1, 2 or 3 counts 0.
    """
    mine = messages.join(snapshot.select("conversation_id"), "conversation_id", "left_semi")
    labels = conversations.select("conversation_id", "L1", "L2", "severity", "last_ts_ms")
    rows = conversation_texts(mine).join(snapshot, "conversation_id").join(labels, "conversation_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    score = F.when(F.col("score").isin(1, 2, 3), F.col("score")).otherwise(0)
    return rows.select("conversation_id", "text", "platform", "appversion", text("L1"), text("L2"), text("severity"), F.coalesce("last_ts_ms", F.lit(0)).alias("last_ts_ms"), score.cast("int").alias("ai_score"), text("reason"), "snapshot_order")


def best_samples(samples: DataFrame, n: int = MAX_SAMPLES) -> DataFrame:
    return samples.orderBy(F.desc("ai_score"), F.desc("last_ts_ms"), "snapshot_order").limit(n)


def report_stats(samples: DataFrame) -> DataFrame:
    """(dim, value, n) over samples, from one scan; empty values are 未知, score 0 is 未精筛. Tags count as one joined text."""
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("未知"))
    dims = {c: name(c) for c in ("platform", "appversion", "severity", "L1", "L2")} | {"ai_score": F.when(F.col("ai_score") > 0, F.col("ai_score").cast("string")).otherwise("未精筛")}
    every = F.array(*[F.struct(F.lit(d).alias("dim"), v.alias("value")) for d, v in dims.items()])
    return samples.select(F.explode(every).alias("e")).groupBy("e.dim", "e.value").agg(F.count("*").alias("n"))


def report_range(samples: DataFrame) -> DataFrame:
    """One row: sample_count, and the first and last time (null without times)."""
    at = F.nullif(F.col("last_ts_ms"), F.lit(0))
    return samples.agg(F.count("*").alias("sample_count"), F.min(at).alias("from_ms"), F.max(at).alias("to_ms"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """(snapshot_order, line): each sample as it goes into a report's prompt."""
    or_dash = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d))
    score = F.when(F.col("ai_score") > 0, F.col("ai_score").cast("string")).otherwise("未精筛")
    line = F.concat(
        F.lit("- 会话 "), F.col("conversation_id"), F.lit(" | AI相关性 "), score, F.lit(" | 平台 "), or_dash("platform", "未知"), F.lit(" | 版本 "), or_dash("appversion", "未知"),
        F.lit(" | 标签弱参考 "), or_dash("L1", "-"), F.lit(" / "), or_dash("L2", "-"), F.lit(" / "), or_dash("severity", "-"), F.lit("\n  原文："), F.col("text"),
    )
    return samples.select("snapshot_order", line.alias("line"))


def batch_size(n: int, asked: int = 1) -> int:
    """Conversations of one call: 1 up to 50, 2 up to 200, else 5, or more if asked."""
    own = 1 if n <= 50 else 2 if n <= 200 else 5
    return max(own, asked) if asked > 1 else own


def score_conversations(texts: DataFrame, query: str, ask: Callable[[str, list[tuple[str, str]]], list[dict]], *, size: int | None = None, partitions: int | None = None) -> DataFrame:
    """(conversation_id, score, reason) from a model called with (query, [(id, text)...]) in batches.

    Without ``size`` the batches follow from the number of conversations, by
    ``batch_size``. Answers are matched by place. A call that fails gives 2 and
    'timeout', a missing answer 2 and 'missing', a score outside 1..3 counts 2.
    ``partitions`` bounds how many calls run at once; nothing passes through the driver.
    """
    rows = texts.select("conversation_id", "text")
    size = size or batch_size(rows.count())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(zip(batch["conversation_id"], batch["text"].fillna(""), strict=True))
            out = []
            for lo in range(0, len(pairs), size):
                part = pairs[lo : lo + size]
                try:
                    found = ask(query, part)
                except Exception:  # a call that fails costs its batch the scores, not the job
                    found = [{"score": 2, "reason": "timeout"}] * len(part)
                found = [*found, *[{"score": 2, "reason": "missing"}] * len(part)][: len(part)]
                out += [(i, r.get("score") if r.get("score") in (1, 2, 3) else 2, str(r.get("reason") or "")) for (i, _), r in zip(part, found, strict=True)]
            yield pd.DataFrame(out, columns=["conversation_id", "score", "reason"])

    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, "conversation_id string, score int, reason string")


def score_in_turns(texts: DataFrame, query: str, ask: Callable[[str, list[tuple[str, str]]], list[dict]], *, turns: int = 8, seconds: float = 180.0, clock: Callable[[], float] = time.monotonic, **options: int) -> Iterator[DataFrame]:
    """The scores of ``score_conversations``, an even share of the conversations at a time, so that the first ones show early.

    Each part is written before it is handed out. When the time is over, what is
    left comes as one part of score 2 and reason 'timeout', without another call.
    """
    texts = settle(texts.select("conversation_id", "text"), "texts")
    turn = F.pmod(F.xxhash64("conversation_id"), F.lit(turns))
    end = clock() + seconds
    for k in range(turns):
        if clock() >= end:
            yield texts.where(turn >= k).select("conversation_id", F.lit(2).alias("score"), F.lit("timeout").alias("reason"))
            return
        yield settle(score_conversations(texts.where(turn == k), query, ask, **options), "scores")


def report_prompt(samples: DataFrame, question: str) -> DataFrame:
    """One row with the text that a model writes the report from: question, counts of each value, and the best samples."""
    samples = settle(samples.drop("reason"), "samples")  # lines, counts and range read what is put together once
    best = best_samples(samples)
    lines = sample_lines(best).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("snapshot_order", "line"))), lambda x: x["line"]), "\n").alias("lines"))  # MAX_SAMPLES at most
    names = {"L1": "分类", "severity": "严重度", "platform": "平台"}
    counts = report_stats(samples).where(F.col("dim").isin(*names)).groupBy("dim").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))), 1, 10), lambda x: F.concat(x["value"], F.lit(" "), (-x["m"]).cast("string"))), "，").alias("said"))
    shown = counts.agg(*[F.coalesce(F.max(F.when(F.col("dim") == d, F.col("said"))), F.lit("无")).alias(d) for d in names])
    head = F.concat(F.lit(f"# 用户反馈分析：{question}\n\n样本数："), F.col("sample_count").cast("string"), *[x for d, name in names.items() for x in (F.lit(f"\n{name}："), F.col(d))], F.lit("\n\n"), F.col("lines"))
    return report_range(samples).crossJoin(shown).crossJoin(lines).select(head.alias("prompt"))  # one row each


def parse_score(reply: Column) -> Column:
    """Array of (score, reason) from a model's reply: an object or a list; null if it is no JSON."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    text = F.trim(F.coalesce(fenced, reply))
    shape = "array<struct<score:string,reason:string>>"
    found = F.when(text.startswith("["), F.from_json(text, shape)).when(text.startswith("{"), F.from_json(F.concat(F.lit("["), text, F.lit("]")), shape))
    good = lambda x: F.when(x["score"].isin("1", "2", "3"), x["score"].cast("int")).otherwise(2)
    return F.transform(found, lambda x: F.struct(good(x).alias("score"), F.coalesce(x["reason"], F.lit("")).alias("reason")))
