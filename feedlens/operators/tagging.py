"""Rule tagger: the first rule that fits gives the label, as one struct expression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens.functions import text as T

LABEL = "L1 string, L2 array<string>, severity string, confidence double, reason string, source string, rule_name string"
EMOJI = r"\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}"
#: The rules in their order, with the L1 of each.
RULE_L1 = {
    "empty": "E.无效", "too_short": "E.无效", "pure_emoji": "E.无效", "invalid_kw": "E.无效", "emotion_pos": "D.情绪", "emotion_neg": "D.情绪",
    "bug_p0": "A.Bug", "suggest": "B.建议", "question": "C.咨询", "bug_general": "A.Bug",
}


def _rule_of(s: str, folded: str, r: C.TagRules, bits: T.WordBits) -> str:
    """SQL text: the number, from 1, of the first rule that fits; null for no rule."""
    marks = f"rlike({s}, {T.literal(f'(?U)^[{EMOJI}{C.PUNCTUATION}]+' + chr(92) + 'z')})"
    short = f"length({s}) <= {C.EMOTION_MAX_LEN}"
    asks = f"(contains({s}, '?') OR contains({s}, '？') OR length({s}) <= {C.QUESTION_SHORT_LEN})"
    match = lambda patterns: T.sql_matches(s, patterns, folded=folded, bits=bits)
    tests = {
        "empty": f"{s} = ''", "too_short": f"length({s}) <= {C.TOO_SHORT_LEN}", "pure_emoji": marks, "invalid_kw": match(r.invalid), "emotion_pos": f"{short} AND {match(r.pos)}",
        "emotion_neg": f"{short} AND {match(r.neg)}", "bug_p0": match(r.p0), "suggest": match(r.suggest), "question": f"{asks} AND {match(r.question)}", "bug_general": match(r.bug),
    }
    return "CASE " + " ".join(f"WHEN {tests[name]} THEN {k}" for k, name in enumerate(RULE_L1, 1)) + " END"


def _by_rule(values: dict[str, str]) -> str:
    """SQL text: the constant of the rule, looked up in an array, so that the rule is named once wherever filters are pushed to."""
    return "get(array(" + ", ".join(values[name] for name in RULE_L1) + "), _rule - 1)"  # null for a null, which element_at isn't under ANSI rules


def with_rule_label(rows: DataFrame, rules: C.TagRules = C.TagRules()) -> DataFrame:
    """Adds L1, L2, severity, confidence, reason, source and rule_name of the first rule that fits the text; nulls where none does.

    A null text fits no rule. All plain words of the rules are found by one pass
    over the text in lower case, those of the tags by one over the text; bits tell which. Only texts that a class of patterns claims look for its first pattern,
    for the reason. The list of tags is built once for all rules.
    """
    s, folded = "_s", "_folded"
    bits = T.WordBits.of_patterns((rules.invalid, rules.pos, rules.neg, rules.p0, rules.suggest, rules.question, rules.bug))
    kinds: dict[str, set[str]] = {}
    for tag, words in rules.l2.items():
        for w in words:
            kinds.setdefault(w, set()).add(tag)
    alike = {frozenset(v): k for k, v in enumerate(dict.fromkeys(map(frozenset, kinds.values())))}  # words of the same tags share a bit
    tag_bits = T.WordBits(kinds, "_tagged", {w: alike[frozenset(v)] for w, v in kinds.items()})
    found = "array_compact(array(" + ", ".join(f"CASE WHEN {tag_bits.test(words)} THEN {T.literal(tag)} END" for tag, words in rules.l2.items()) + "))"
    other, none = "array('其他')", "CAST(array() AS array<string>)"
    first_tagged = list(RULE_L1).index("bug_p0") + 1  # this rule and those after it have tags
    l2 = dict.fromkeys(RULE_L1, none) | {"empty": other, "too_short": other, "pure_emoji": "array('符号表情')", "invalid_kw": other}
    because = lambda words, patterns: f"concat({T.literal(words)}, {T.sql_first_match(s, patterns, folded=folded, bits=bits)})"
    reasons = {
        "empty": "'空文本'", "too_short": "'单字符无效内容'", "pure_emoji": "'纯表情或标点'", "invalid_kw": because("命中无效模式 ", rules.invalid), "emotion_pos": "'短句正向情绪'", "emotion_neg": "'短句负向情绪'",
        "bug_p0": because("P0 关键词 ", rules.p0), "suggest": because("建议关键词 ", rules.suggest), "question": because("咨询句式 ", rules.question), "bug_general": because("Bug 关键词 ", rules.bug),
    }
    numbers = bits.columns("_words") | tag_bits.columns("_tag_words")
    texts = rows.withColumn(s, T.strip(F.col("text"))).withColumn(folded, F.lower(s))
    texts = texts.withColumns({"_words": F.expr(bits.found(folded)), "_tag_words": F.expr(tag_bits.found(s))}).withColumns({n: F.expr(c) for n, c in numbers.items()})
    # a generated column: filters on labels stay above it, where one pushed down would find the words a second time
    texts = texts.select("*", F.explode(F.array(F.expr(_rule_of(s, folded, rules, bits)))).alias("_rule"))
    claimed = texts.withColumn("_tags", F.expr(f"CASE WHEN _rule >= {first_tagged} THEN {found} END"))
    return claimed.withColumns({
        "L1": F.expr(_by_rule({k: T.literal(v) for k, v in RULE_L1.items()})),
        "L2": F.expr(f"CASE WHEN _tags IS NULL THEN {_by_rule(l2)} WHEN size(_tags) = 0 THEN {other} ELSE _tags END"),
        "severity": F.expr(f"CASE WHEN _rule = {len(RULE_L1)} AND rlike({s}, {T.literal(C.UPLIFT_PATTERN)}) THEN 'P1' ELSE {_by_rule(dict.fromkeys(RULE_L1, T.literal('P3')) | {'bug_p0': T.literal('P0'), 'bug_general': T.literal('P2')})} END"),
        "confidence": F.expr(_by_rule({k: f"{v}D" for k, v in C.CONFIDENCE.items()})),
        "reason": F.expr("CASE _rule " + " ".join(f"WHEN {k} THEN {reasons[name]}" for k, name in enumerate(RULE_L1, 1)) + " END"),
        "source": F.expr("CASE WHEN _rule IS NOT NULL THEN 'rule' END"),
        "rule_name": F.expr("'rule:' || " + _by_rule({k: T.literal(k) for k in RULE_L1})),
    }).drop(s, folded, "_words", "_tag_words", "_rule", "_tags", *numbers)


def fallback_label(reason: Column | str) -> Column:
    lit = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit("待定").alias("L1"), F.array().cast("array<string>").alias("L2"), F.lit("P3").alias("severity"), F.lit(0.0).alias("confidence"), lit.alias("reason"), F.lit("llm").alias("source"), F.lit(None).cast("string").alias("rule_name"))


def parse_reply(reply: Column) -> Column:
    """The label struct of a model's reply: JSON in a json fence, in any fence, or between braces.

    Values outside the enumerations fall back to their defaults, the confidence
    is clamped, the reason is cut to 80 characters.
    """
    text = F.coalesce(reply, F.lit(""))
    fenced = F.nullif(F.regexp_extract(text, r"(?is)```json\s*(.+?)\s*```", 1), F.lit(""))
    anyway = F.trim(F.regexp_extract(text, r"(?s)```\s*(.+?)\s*```", 1))
    braces = F.nullif(F.regexp_extract(text, r"(\{[\s\S]*\})", 1), F.lit(""))
    raw = F.coalesce(fenced, F.when(anyway.startswith("{"), anyway), braces)
    obj = F.from_json(raw, "L1 string, L2 array<string>, severity string, confidence string, reason string")
    valid = F.get_json_object(raw, "$").isNotNull()
    isin = lambda c, values, default: F.when(c.isin(*values), c).otherwise(F.lit(default))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(obj["confidence"].try_cast("double"), F.lit(0.0))))
    reason = F.coalesce(F.nullif(F.substring(T.strip(F.coalesce(obj["reason"], F.lit(""))), 1, 80), F.lit("")), F.lit("llm"))
    good = F.struct(
        isin(obj["L1"], C.L1_VALUES, "待定").alias("L1"), F.filter(F.coalesce(obj["L2"], F.array().cast("array<string>")), lambda x: x.isin(*C.L2_VALUES)).alias("L2"),
        isin(obj["severity"], C.SEVERITY_VALUES, "P3").alias("severity"), confidence.alias("confidence"), reason.alias("reason"), F.lit("llm").alias("source"), F.lit(None).cast("string").alias("rule_name"),
    )
    broken = F.when(raw.isNull(), "parse_error: no_json_found").when(~valid, "parse_error: JSONDecodeError").when(~raw.startswith("{"), "parse_error: not_object")
    return F.when(broken.isNotNull(), fallback_label(broken)).otherwise(good)


LABEL_COLUMNS = ("L1", "L2", "severity", "confidence", "reason", "source")


def with_label(messages: DataFrame, rules: C.TagRules = C.TagRules(), *, reply: Column | None = None) -> DataFrame:
    """Adds the label of each message to its row: by rule, else from ``reply`` (an expression for the model's answer), else pending.

    rule_name is null for labels that no rule gave.
    """
    ruled = with_rule_label(messages, rules)
    other = parse_reply(reply) if reply is not None else fallback_label("parse_error: no_json_found")
    open_ = F.col("rule_name").isNull()
    out = ruled.withColumn("_other", F.when(open_, other))
    return out.withColumns({c: F.when(open_, F.col(f"_other.{c}")).otherwise(F.col(c)) for c in LABEL_COLUMNS}).drop("_other")


def with_label_once(messages: DataFrame, rules: C.TagRules = C.TagRules(), *, texts: DataFrame | None = None) -> DataFrame:
    """The result of ``with_label`` without replies, each different text labelled once and its label joined: users say the same words, and the rules cost more than an exchange.

    ``texts`` is a plainer frame that holds every text of the messages, to find the different ones in.
    """
    told = with_label((messages if texts is None else texts).select(F.col("text").alias("_text")).distinct().withColumnRenamed("_text", "text"), rules)
    told = told.withColumnRenamed("text", "_text")
    return messages.join(told, F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text")


def tag_messages(messages: DataFrame, rules: C.TagRules = C.TagRules(), *, reply: Column | None = None, tagged_at: int = 0) -> DataFrame:
    """Labels of (feedback_id, text) as a table of their own."""
    return with_label(messages, rules, reply=reply).select("feedback_id", *LABEL_COLUMNS, "rule_name", F.lit(tagged_at).cast("long").alias("tagged_at"))


def model_replies(rows: DataFrame, ask: Callable[[list[str]], list[str]], *, key: str = "feedback_id", size: int = 16, partitions: int | None = None) -> DataFrame:
    """(key, reply) of messages or posts that a model has to label, asked in batches of ``size`` texts.

    Answers are matched by place. A batch that fails is asked again one by one,
    and what still fails is answered by its error's class name; a missing answer
    is null. ``partitions`` bounds how many calls run at once.
    """

    def one(text: str) -> str | None:
        try:
            return (ask([text]) or [None])[0]
        except Exception as e:  # a call that fails labels its message as pending
            return f"llm_error: {type(e).__name__}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, replies = batch["text"].fillna("").tolist(), []
            for lo in range(0, len(texts), size):
                part = texts[lo : lo + size]
                try:
                    replies += [*ask(part), *[None] * len(part)][: len(part)]
                except Exception:
                    replies += [one(t) for t in part]
            yield pd.DataFrame({key: batch[key], "reply": replies})

    rows = rows.select(F.col(key).cast("string"), "text")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(run, f"{key} string, reply string")


def untagged(messages: DataFrame, labels: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Messages without a label, oldest first: all of them, or the first ``limit``."""
    rows = messages.join(labels.select("feedback_id"), "feedback_id", "left_anti").orderBy("ts_ms", "feedback_id")
    return rows if limit is None else rows.limit(limit)


def tag_stats(labels: DataFrame) -> DataFrame:
    """(by_rule, by_llm, pending) of a run."""
    pending = F.col("L1") == "待定"
    return labels.agg(F.count_if(F.col("source") == "rule").alias("by_rule"), F.count_if((F.col("source") != "rule") & ~pending).alias("by_llm"), F.count_if(pending).alias("pending"))
