"""Text expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: generated ones, which no later step or filter repeats as it would repeat an expression that it names more than once."""
    for name, c in columns.items():
        rows = rows.select("*", F.explode(F.array(c)).alias(name))
    return rows


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


#: White space that ``strip`` takes off, the control characters 1C to 1F among it.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _UPPER.lower())


def fold(term: str) -> str:
    """Lower case of ASCII letters alone."""
    return term.translate(str.maketrans(_UPPER, _UPPER.lower()))


def contains_fold(c: Column, term: str) -> Column:
    """Literal substring test that ignores the case of ASCII letters; null gives null.

    A term with letters is a quoted pattern, which folds as it goes; others need no folding.
    """
    if not any(x in _UPPER for x in term.upper() if x.isascii()):
        return c.contains(term)
    return c.rlike(r"(?i)\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E")


def literal(value: str) -> str:
    """A text as a Spark SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_contains(column: str, terms: Iterable[str], *, fold: bool = False) -> str:
    """SQL text of ``contains_any``: long word lists are parsed at once, which is much faster than to build them call by call."""
    return "(" + " OR ".join(f"contains({f'lower({column})' if fold else column}, {literal(t.lower() if fold else t)})" for t in terms) + ")"


_META = re.compile(r"[\\.^$*+?{}\[\]|()]")


def _kind(pattern: str) -> tuple[str, str]:
    """whole, part or regex, and the text in lower case where the pattern is a plain word."""
    inner = pattern[1:-1] if len(pattern) > 1 and pattern[0] == "^" and pattern[-1] == "$" else None
    if inner is not None and not _META.search(inner):
        return "whole", inner.lower()
    return ("regex", pattern) if _META.search(pattern) else ("part", pattern.lower())


class WordBits:
    """All plain words that rules look for, found in one pass over a text.

    One pattern looks, at each place, for the longest word that begins there. A word's
    bits are its own and those of the words that it begins with; what is inside it
    is found at its own place. ``columns`` gives the bits as numbers of 62 bits; ``test`` asks them for words.
    """

    def __init__(self, words: Iterable[str], name: str = "_bits", group: dict[str, int] | None = None):
        """``group`` gives words a common bit; without it each has its own."""
        self.words = list(dict.fromkeys(words))
        self.name, self.bit = name, group or {w: k for k, w in enumerate(self.words)}

    @classmethod
    def of_patterns(cls, lists: Iterable[Iterable[str]], name: str = "_bits") -> WordBits:
        """The plain words among the patterns, in lower case."""
        return cls([w for patterns in lists for k, w in map(_kind, patterns) if k == "part"], name)

    @property
    def slots(self) -> int:
        return max(self.bit.values(), default=-1) // 62 + 1

    def found(self, column: str) -> str:
        """SQL text: the longest words at all places of a column of text."""
        ordered = sorted(self.words, key=lambda w: (-len(w), w))
        first = "".join(dict.fromkeys(w[0] for w in ordered)).replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-").replace("[", "\\[").replace("&", "\\&")
        return f"regexp_extract_all({column}, {literal(f'(?s)(?=[{first}])(?=(' + '|'.join(map(_quoted, ordered)) + '))')}, 1)"

    def columns(self, found: str) -> dict[str, str]:
        """SQL text by name of each number, from the column of what ``found`` gives."""
        out = {}
        for slot in range(self.slots):
            own = {w: sum({1 << self.bit[v] % 62 for v in self.words if w.startswith(v) and self.bit[v] // 62 == slot}) for w in self.words}
            pairs = ", ".join(f"{literal(w)}, {n}L" for w, n in own.items() if n)
            out[f"{self.name}{slot}"] = f"aggregate({found}, 0L, (seen, w) -> seen | coalesce(try_element_at(map({pairs}), w), 0L))"
        return out

    def test(self, words: Iterable[str]) -> str:
        """SQL text: one of the words is in the text."""
        slots: dict[int, int] = {}
        for w in words:
            slots[self.bit[w] // 62] = slots.get(self.bit[w] // 62, 0) | 1 << self.bit[w] % 62
        return " OR ".join(f"({self.name}{k} & {n}L) != 0" for k, n in slots.items()) or "false"


def _quoted(word: str) -> str:
    return _META.sub(lambda m: "\\" + m[0], word)


def sql_matches(column: str, patterns: Iterable[str], *, folded: str, bits: WordBits) -> str:
    """SQL text: the text matches one of the patterns, without regard to case.

    ``folded`` names the text in lower case. Plain words are asked from its
    ``bits``; only what needs a regular expression is one, in one alternation.
    """
    kinds = [_kind(p) for p in patterns]
    tests = [bits.test(w for k, w in kinds if k == "part")]
    if whole := [literal(w) for k, w in kinds if k == "whole"]:
        tests.append(f"{folded} IN ({', '.join(whole)})")
    if regex := [p for k, p in kinds if k == "regex"]:
        tests.append(f"rlike({column}, {literal('(?iu)' + '|'.join(f'(?:{p})' for p in regex))})")
    return "(" + " OR ".join(tests) + ")"


def sql_first_match(column: str, patterns: Iterable[str], *, folded: str, bits: WordBits) -> str:
    """SQL text: the first pattern of the list that the text matches, or null."""
    return "CASE " + " ".join(f"WHEN {sql_matches(column, [p], folded=folded, bits=bits)} THEN {literal(p)}" for p in patterns) + " END"


def contains_any(c: Column, terms: Iterable[str], *, fold: bool = False) -> Column:
    return any_of((F.lower(c).contains(t.lower()) if fold else c.contains(t)) for t in terms)


def matches(c: Column, pattern: str) -> Column:
    """Regular-expression search without regard to case."""
    return c.rlike(f"(?iu){pattern}")


def split_list(c: Column, mark: str = "|") -> Column:
    """Parts of a joined list, without empty ones; null stays null."""
    return F.filter(F.split(c, f"[{mark}]"), lambda x: x != "")


def major_version(c: Column) -> Column:
    """All before the last dot; ``_unknown`` for null or empty."""
    return F.when(c.isNull() | (c == ""), F.lit("_unknown")).otherwise(F.regexp_replace(c, r"\.[^.]*$", ""))


def primary_tag(c: Column) -> Column:
    """First part of a joined list, ``_unknown`` if there is none."""
    return F.coalesce(F.nullif(F.trim(F.split_part(c, F.lit("|"), F.lit(1))), F.lit("")), F.lit("_unknown"))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def percent(part: Column, whole: Column) -> Column:
    """A share with one decimal, or a dash where there is nothing to divide by."""
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole)).otherwise(F.lit("—"))


def time_bucket(ts_ms: Column, granularity: str) -> Column:
    """Day or hour of a time in milliseconds, as text in the session's time zone."""
    shapes = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd HH:00"}
    if granularity not in shapes:
        raise ValueError(f"granularity must be one of {sorted(shapes)}")
    return F.date_format(F.timestamp_millis(ts_ms), shapes[granularity])


def platform_name(code: Column, device: Column) -> Column:
    """Platform from its code, else from the device text, else 'unknown' with the code."""
    d = F.lower(F.coalesce(device, F.lit("")))
    known = F.create_map(*[F.lit(x) for pair in {1: "iOS", 2: "Android", 7: "Win", 9: "Mac", 11: "小程序"}.items() for x in pair])
    return F.coalesce(
        known[code],
        F.when(contains_any(d, ("iphone", "ipad", "ios")), "iOS"),
        F.when(d.contains("android"), "Android"),
        F.when(contains_any(d, ("windows", "win64")), "Win"),
        F.when(contains_any(d, ("mac os", "macintosh", "macos")), "Mac"),
        F.concat(F.lit("未知(p="), F.coalesce(code.cast("string"), F.lit("None")), F.lit(")")),
    )


def chat_url(base: str, channel: Column, service: Column, user: Column) -> Column:
    """Link to a user's conversation; null without a user."""
    return F.when(
        user.isNotNull() & (user != ""),
        F.concat(F.lit(f"{base}?channel="), F.url_encode(F.coalesce(F.nullif(channel, F.lit("")), F.lit("default"))), F.lit("&serviceVid="), F.url_encode(F.coalesce(service, F.lit(10000)).cast("string")), F.lit("&userVid="), F.url_encode(user)),
    )
