"""Keyword, intent and regex search: conditions on one message, lifted to conversations by semi and anti joins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens.functions import text as T
from feedlens.operators.filters import with_message, without_message

#: Texts as long as this, or longer, take no part in regex search: patterns may backtrack.
REGEX_TEXT_CHARS = 2000
PATTERN_CHARS = 200
TERM_CHARS = 30


@dataclass(frozen=True)
class KeywordGroup:
    keywords: Sequence[str]
    logic: str = "AND"

    def __post_init__(self):
        if self.logic not in ("AND", "OR"):
            raise ValueError(f"logic must be AND or OR: {self.logic}")


@dataclass(frozen=True)
class Intent:
    """Terms of a group are alternatives. All groups of ``must`` have to match in one message; without it, any of ``should``."""

    must: Sequence[Sequence[str]] = ()
    should: Sequence[Sequence[str]] = ()
    exclude: Sequence[str] = ()


@dataclass(frozen=True)
class PatternGroups:
    groups: Sequence[tuple[Sequence[str], str]] = field(default_factory=tuple)  # (patterns, AND or OR)
    logic: str = "OR"


def has_term(term: str) -> Column:
    return T.contains_fold(F.col("text"), term)


def keyword_condition(groups: Sequence[KeywordGroup]) -> Column:
    used = [g for g in groups if g.keywords]
    if not used:
        raise ValueError("at least one keyword is needed")
    return T.any_of((T.all_of if g.logic == "AND" else T.any_of)(map(has_term, g.keywords)) for g in used)


def keyword_search(conversations: DataFrame, messages: DataFrame, groups: Sequence[KeywordGroup], excludes: Sequence[str] = ()) -> DataFrame:
    """Conversations with a message that fits one of the groups, and none with an excluded word."""
    out = with_message(conversations, messages, keyword_condition(groups))
    return without_message(out, messages, T.any_of(map(has_term, excludes))) if excludes else out


def describe(groups: Sequence[KeywordGroup], excludes: Sequence[str] = ()) -> str:
    """A keyword search in words, as the question for relevance scores."""
    quoted = lambda words, sep: sep.join(f"'{w}'" for w in words)
    said = ["包含" + quoted(g.keywords, " 和 " if g.logic == "AND" else " 或 ") for g in groups if g.keywords]
    return "，".join([*said, *(["排除" + quoted(excludes, "、")] if excludes else [])])


def intent_condition(intent: Intent) -> Column | None:
    """The condition on a message, or None if no term is left."""
    groups = [[t.strip() for t in g if t.strip()] for g in (intent.must or intent.should)]
    groups = [T.any_of(map(has_term, g)) for g in groups if g]
    return (T.all_of if intent.must else T.any_of)(groups) if groups else None


def intent_search(conversations: DataFrame, messages: DataFrame, intent: Intent) -> DataFrame:
    excludes = [t.strip() for t in intent.exclude if t.strip()]
    condition = intent_condition(intent)
    if condition is None and not excludes:
        raise ValueError("the intent has no terms")
    out = conversations if condition is None else with_message(conversations, messages, condition)
    return without_message(out, messages, T.any_of(map(has_term, excludes))) if excludes else out


#: Parts of a parsed pattern that stand for one character.
_SINGLE = ("LITERAL", "NOT_LITERAL", "ANY", "IN", "CATEGORY")


def _children(argument: object):
    """The parsed patterns inside an item's argument."""
    if isinstance(argument, _parser.SubPattern):
        yield argument
    elif isinstance(argument, list | tuple):
        for part in argument:
            yield from _children(part)


def _wildcards(parsed: _parser.SubPattern, repeated: bool = False) -> int | None:
    """The open-ended repeats of any character in a parsed pattern; None if a group, or what is repeated already, is repeated without end."""
    total = 0
    for kind, argument in parsed:
        repeats = str(kind).endswith("_REPEAT")
        endless = repeats and argument[1] == _parser.MAXREPEAT
        if endless:
            body = [str(k) for k, _ in argument[2]]
            if repeated or len(body) != 1 or body[0] not in _SINGLE:
                return None
            total += body == ["ANY"]
        for child in _children(argument):
            inner = _wildcards(child, repeated or repeats)
            if inner is None:
                return None
            total += inner
    return total


def safe_patterns(patterns: Sequence[object]) -> list[str]:
    """The patterns that compile, are short, don't repeat a group or a repeat without end, and hold one open-ended wildcard at most."""
    out = []
    for p in patterns:
        if not isinstance(p, str) or len(p) > PATTERN_CHARS:
            continue
        try:
            found = _wildcards(_parser.parse(p))
        except re.error:
            continue
        if found is not None and found <= 1:
            out.append(p)
    return out


def guarded(pattern: str) -> Column:
    """Case-insensitive regex search in texts that are short enough; the length is tested first."""
    return (F.length("text") < REGEX_TEXT_CHARS) & T.matches(F.col("text"), pattern)


def regex_condition(patterns: PatternGroups) -> Column | None:
    pick = {"AND": T.all_of, "OR": T.any_of}
    groups = [pick[logic](T.matches(F.col("text"), p) for p in safe) for ps, logic in patterns.groups if (safe := safe_patterns(ps))]
    return (F.length("text") < REGEX_TEXT_CHARS) & pick[patterns.logic](groups) if groups else None


def regex_search(conversations: DataFrame, messages: DataFrame, patterns: PatternGroups) -> DataFrame:
    condition = regex_condition(patterns)
    if condition is None:
        raise ValueError("no usable pattern")
    return with_message(conversations, messages, condition)


def plain_words(texts: Sequence[str], most: int = 5) -> list[str]:
    """Runs of Han characters or ASCII letters: what is left to search for where nothing better is known."""
    return [w for t in texts for w in re.findall(r"[一-鿿]+|[a-zA-Z]+", t)][:most]


def fallback_search(conversations: DataFrame, messages: DataFrame, texts: Sequence[str]) -> DataFrame:
    words = plain_words(texts)
    if not words:
        raise ValueError("nothing to search for")
    return with_message(conversations, messages, T.any_of(map(has_term, words)))


def plain_words_column(text: Column, most: int = 5) -> Column:
    """``plain_words`` of a column."""
    return F.slice(F.regexp_extract_all(text, F.lit(r"[\x{4e00}-\x{9fff}]+|[a-zA-Z]+"), F.lit(0)), 1, most)
