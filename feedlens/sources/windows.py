"""Time windows of a run, resolved once on the driver, and times in columns."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M", "%Y-%m-%d")
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def to_ms(moment: datetime) -> int:
    return int(moment.timestamp() * 1000)


def parse_time(value: str | None, *, end_of_day: bool = False, zone: timezone = UTC) -> int | None:
    """Milliseconds of a time as text; None for none. A date alone, as an upper bound, means 23:59:59 of it."""
    if not value or not value.strip():
        return None
    for shape in FORMATS:
        try:
            at = datetime.strptime(value.strip(), shape).replace(tzinfo=zone)
        except ValueError:
            continue
        return to_ms(at + timedelta(hours=23, minutes=59, seconds=59) if end_of_day and shape == FORMATS[-1] else at)
    raise ValueError(f"not a time: {value!r}")


def resolve_window(now: datetime, *, ts: tuple[int, int] | None = None, span: tuple[str, str] | None = None, last: str | None = None, date: str | None = None) -> tuple[int, int]:
    """(start, end) in milliseconds, from the first that is given: seconds, texts, a length such as 2h, a date; else the last day."""
    if ts:
        return ts[0] * 1000, ts[1] * 1000
    if span:
        return parse_time(span[0]), parse_time(span[1])
    if last is not None:
        unit = last.strip().lower()[-1:]
        if unit not in UNITS:
            raise ValueError(f"length needs one of {sorted(UNITS)}: {last!r}")
        return to_ms(now - timedelta(seconds=float(last.strip()[:-1]) * UNITS[unit])), to_ms(now)
    if date:
        start = parse_time(date) // 86_400_000 * 86_400_000
        return start, start + 86_400_000
    return to_ms(now - timedelta(days=1)), to_ms(now)


def day_range(date: str, *, hours_east: int = 8) -> tuple[int, int]:
    """Half-open [start, end) of a calendar day in a fixed zone."""
    start = parse_time(date, zone=timezone(timedelta(hours=hours_east)))
    return start, start + 86_400_000


#: How ``time_ms`` reads texts, as patterns of Spark.
SHAPES = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm")


def time_ms(text: Column, *, end_of_day: bool = False) -> Column:
    """``parse_time`` of a column, in the session's zone; null where a text is no time."""
    clean = F.trim(text)
    day = F.try_to_timestamp(clean, F.lit("yyyy-MM-dd"))
    day = day + F.expr("INTERVAL '23:59:59' HOUR TO SECOND") if end_of_day else day
    return F.unix_millis(F.coalesce(*[F.try_to_timestamp(clean, F.lit(s)) for s in SHAPES], day))
