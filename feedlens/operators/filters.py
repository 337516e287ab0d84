"""Filters over conversations, built from typed parameters; bad values raise before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens.functions import text as T
from feedlens.sources.windows import parse_time


def parts(value: str | None) -> list[str]:
    """Parts of a comma list, trimmed, each once, without empty ones."""
    return list(dict.fromkeys(p.strip() for p in (value or "").split(",") if p.strip()))


def merge_parts(value: str | None, more: list[str]) -> str | None:
    return ",".join(parts(",".join([value or "", *more]))) or None


def check_page(limit: int, offset: int, *, most: int = 500) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


@dataclass(frozen=True)
class Filters:
    """What a conversation list can be narrowed by; platform, version and device are comma lists (OR inside one)."""

    since: str | None = None
    until: str | None = None
    L1: str | None = None
    L2: str | None = None
    severity: str | None = None
    q: str | None = None
    platform: str | None = None
    appversion: str | None = None
    device_name: str | None = None

    def __post_init__(self):
        for name, allowed in (("L1", C.L1_VALUES), ("L2", C.L2_VALUES), ("severity", C.SEVERITY_VALUES)):
            value = getattr(self, name)
            if value and value not in allowed:
                raise ValueError(f"unknown {name}: {value}")
        parse_time(self.since), parse_time(self.until)

    def any(self) -> bool:
        return any(getattr(self, f) for f in self.__dataclass_fields__ if f != "q")


def on_conversation(f: Filters) -> Column:
    """The filters that columns of a conversation decide; all of them can reach the scan but the tag test."""
    found = []
    if (ms := parse_time(f.since)) is not None:
        found.append(F.col("last_ts_ms") >= ms)
    if (ms := parse_time(f.until, end_of_day=True)) is not None:
        found.append(F.col("last_ts_ms") <= ms)
    found += [F.col(c) == v for c, v in (("L1", f.L1), ("severity", f.severity)) if v]
    if f.L2:
        found.append(F.array_contains(T.split_list(F.col("L2")), f.L2))
    if versions := parts(f.appversion):
        found.append(T.any_of(F.col("appversion").startswith(v) for v in versions))
    return T.all_of(found)


def with_message(conversations: DataFrame, messages: DataFrame, condition: Column) -> DataFrame:
    """Conversations of which at least one message fits."""
    return conversations.join(messages.where(condition).select("conversation_id"), "conversation_id", "left_semi")


def without_message(conversations: DataFrame, messages: DataFrame, condition: Column) -> DataFrame:
    """Conversations of which no message fits."""
    return conversations.join(messages.where(condition).select("conversation_id"), "conversation_id", "left_anti")


def narrow(conversations: DataFrame, messages: DataFrame, f: Filters) -> DataFrame:
    """Conversations that pass all filters; each message condition is a semi join of its own."""
    out = conversations.where(on_conversation(f))
    if f.q:
        out = with_message(out, messages, T.contains_fold(F.col("text"), f.q))
    if platforms := parts(f.platform):
        out = with_message(out, messages, F.col("platform").isin(*platforms))
    if devices := parts(f.device_name):
        out = with_message(out, messages, T.any_of(F.lower("device_name").contains(d.lower()) for d in devices))
    return out
