"""Line-first quality rules.

Every line is judged by punctuation, navigation and boilerplate rules; lines
that fail are removed; documents that lose too much of their text are rejected.
Rules go by code points of any script: marks that end sentences, entries of a
menu or path between separators, runs of links, and what notices say. All counts of a
batch come from arrays; a document is never cut.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import map_batches, map_rows

#: Characters that text made of symbols is full of.
SYMBOLS = "#*$%&|<>"
EMPHASIS = "!?#*$%&<>{}[]\\^~=_+@！？＃＊"
#: What separates entries of a menu or a path. A right guillemet does so too, in lines without a left one.
SEPARATORS = "|¦·•›→"
LEFT, RIGHT = "«", "»"
#: Marks after sentences and clauses, of all scripts that have them.
TERMINALS = ".!?:;…‽。．！？：；｡।॥؟۔؛։՜՞።፡፧៕។။၊᠃᠉꓿"
#: Scripts without spaces between words, two characters of which count as a word, and scripts without marks after sentences.
WIDE = ((0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))
UNMARKED = ((0x0E00, 0x0EFF),)
LINKS = ("://", "www.")
#: What lines of notices and page furniture say, in several languages, in lower case, and a dated copyright mark.
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright", "cookie", "privacy policy", "terms of use", "terms of service",
    "subscribe", "sign up", "log in", "click here", "javascript", "read more", "share this",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "nutzungsbedingungen", "weiterlesen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "conditions d’utilisation", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "condiciones de uso", "leer más",
    "todos os direitos reservados", "tutti i diritti riservati", "все права защищены", "политика конфиденциальности",
    "版权所有", "保留所有权利", "隐私政策", "無断転載", "プライバシーポリシー", "جميع الحقوق محفوظة", "سياسة الخصوصية", "सर्वाधिकार सुरक्षित", "गोपनीयता नीति", "©",
)
COPYRIGHT = r"\(c\) ?(19|20)[0-9]{2}"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; shares are in hundredths."""

    min_separators: int = 2
    separators_per_100_words: int = 33
    words_per_entry: int = 3
    min_links: int = 2
    min_emphasis: int = 3
    emphasis_per_100_words: int = 50
    unpunctuated_words: int = 10
    unpunctuated_wide: int = 40
    boilerplate_words: int = 30
    max_lost: int = 50
    min_words: int = 20
    max_repeated: int = 30


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_navigation long, n_lines_punctuation long, "
    "n_lines_boilerplate long, lost_chars long"
)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SPACE, _EMPH, _SEP, _TERM, _WIDE, _BARE, _LEFT, _RIGHT = (1 << k for k in range(8))
#: The classes of each code point; those beyond the table have none.
_CLASS = np.zeros(0x10000, np.uint8)
for _bit, _chars in ((_EMPH, EMPHASIS), (_SEP, SEPARATORS), (_TERM, TERMINALS), (_LEFT, LEFT), (_RIGHT, RIGHT)):
    _CLASS[[ord(c) for c in _chars]] |= _bit
for _bit, _ranges in ((_SPACE, ((0x20, 0x20), (0x09, 0x0D))), (_WIDE, WIDE), (_BARE, UNMARKED)):
    for _low, _high in _ranges:
        _CLASS[_low : _high + 1] |= _bit


def _repeats(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in an 8-word window found twice or more in it."""
    w, at = spans.windows(h, counts, 8)
    doc = np.repeat(np.arange(len(counts)), counts)
    if not len(w):
        return np.zeros(len(counts), np.int64)
    key = spans.mix(w ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    first = at[twice]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + 8, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts))


class _Lines:
    """The lines of a batch of texts, by code points, and what the rules say of each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, rules: LineRules):
        lead = (buf & 0xC0) != 0x80
        before = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(lead, out=before[1:])
        edges = before[offsets]
        self.text = buf.tobytes().decode()
        self.low = self.text.replace("İ", "\0").replace("ſ", "s").lower()  # as long as the text: only this capital becomes two characters
        point = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        kind = np.where(point < len(_CLASS), _CLASS[np.minimum(point, len(_CLASS) - 1)], np.uint8(0))
        # a text of k line feeds has k + 1 lines
        feeds = np.flatnonzero(point == 10)
        self.start = np.sort(np.concatenate([edges[:-1], feeds + 1]), kind="stable")
        self.end = np.sort(np.concatenate([feeds, edges[1:]]), kind="stable")
        self.per_text = np.diff(np.searchsorted(feeds, edges)) + 1
        space = kind & _SPACE != 0
        fresh = np.ones(len(point) + 1, bool)  # a word may start here
        fresh[1:] = np.append(space, True)[:-1]
        fresh[edges] = True
        starts = np.flatnonzero(fresh[:-1] & ~space)
        self.words = np.searchsorted(starts, self.end) - np.searchsorted(starts, self.start)
        self.chars = self._inside(~space)
        n, r = self.words, rules
        emph, term, wide, bare, left, right = (self._inside(kind & bit != 0) for bit in (_EMPH, _TERM, _WIDE, _BARE, _LEFT, _RIGHT))
        first = np.append(kind, np.uint8(0))[np.append(starts, len(point))[np.searchsorted(starts, self.start)]]
        first = np.where(n > 0, first, 0)
        arrows = left == 0
        seps = self._inside(kind & _SEP != 0) + np.where(arrows, right, 0) - ((first & _SEP != 0) | (arrows & (first & _RIGHT != 0)))
        links = self._found(LINKS)
        units = n + wide // 2
        some = n > 0
        listed = (seps >= r.min_separators) & (100 * seps >= r.separators_per_100_words * units)
        path = (seps >= 1) & (term == 0) & (units <= (r.words_per_entry + 1) * seps + r.words_per_entry)
        self.navigation = some & (listed | path | ((links >= r.min_links) & (2 * links >= n)))
        shouting = (emph >= r.min_emphasis) & (100 * emph > r.emphasis_per_100_words * units)
        unended = (term == 0) & (bare == 0) & ((n >= r.unpunctuated_words) | (wide >= r.unpunctuated_wide))
        self.punctuation = some & ~self.navigation & (shouting | unended)
        self.boilerplate = some & ~self.navigation & ~self.punctuation & (units <= r.boilerplate_words) & (self._found(BOILERPLATE, COPYRIGHT) > 0)
        self.bad = self.navigation | self.punctuation | self.boilerplate

    def _inside(self, flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        return np.searchsorted(at, self.end) - np.searchsorted(at, self.start)

    def _found(self, phrases: tuple[str, ...], pattern: str | None = None) -> np.ndarray:
        """How often any phrase, or the pattern, occurs in each line, whatever its case; none crosses a line feed or a text's end."""
        at = []
        for phrase in phrases:
            k = self.low.find(phrase)
            while k >= 0:
                at.append((k, k + len(phrase)))
                k = self.low.find(phrase, k + len(phrase))
        if pattern and "(c)" in self.low:
            at += [m.span() for m in re.finditer(pattern, self.low)]
        if not at:
            return np.zeros(len(self.start), np.int64)
        begin, stop = np.array(at).T
        line = np.searchsorted(self.start, begin, side="right") - 1
        return np.bincount(line[stop <= self.end[line]], minlength=len(self.start))

    def line(self, k: int) -> str:
        return self.text[self.start[k] : self.end[k]]


def _judge(buf: np.ndarray, offsets: np.ndarray, rules: LineRules, clean: bool):
    n_docs = len(offsets) - 1
    starts, ends, n_words = spans.words(buf, offsets)
    word_chars = spans.per_doc(((buf & 0xC0) != 0x80) & ~spans.SPACE[buf], offsets)
    n_symbols = spans.per_doc(_SYMBOL[buf], offsets)
    repeats = _repeats(spans.hash_spans(buf, starts, ends), n_words)
    lines = _Lines(buf, offsets, rules)
    line_doc = np.repeat(np.arange(n_docs), lines.per_text)
    dup = np.zeros(n_docs, np.int64)
    first = np.concatenate([[0], np.cumsum(lines.per_text)])
    for d in np.flatnonzero(lines.per_text > 1):
        seen = set()
        for k in range(first[d], first[d + 1]):
            if lines.words[k]:
                line = lines.line(k)
                if line in seen:
                    dup[d] += 1
                else:
                    seen.add(line)
    count = lambda flags: np.bincount(line_doc[flags], minlength=n_docs)
    lost = np.bincount(line_doc, weights=np.where(lines.bad, lines.chars, 0), minlength=n_docs).astype(np.int64)
    failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeated * n_words)
    kept = ~failed & (100 * lost <= rules.max_lost * word_chars)
    cols = [n_words, word_chars, n_symbols, dup, repeats, failed, kept, lines.per_text, count(lines.navigation), count(lines.punctuation), count(lines.boilerplate), lost]
    if not clean:
        return cols, None
    texts = []
    for d in range(n_docs):
        if lines.bad[first[d] : first[d + 1]].any():
            texts.append("\n".join(lines.line(k) for k in range(first[d], first[d + 1]) if not lines.bad[k]))
        else:
            texts.append(None)
    return cols, texts


def judge_lines(docs: DataFrame, rules: LineRules = LineRules(), *, cleaned: bool = False) -> DataFrame:
    """Count, clean and judge every document of (doc_id, text).

    Returns one row per input row. A null text has no words and fails; an
    empty line is never removed; rows that repeat are judged one by one; other
    columns are ignored. With ``cleaned`` a column ``text`` holds the lines
    that passed, joined again, and ``text_changed`` tells if any was removed.
    """

    def make():
        def f(batch: pa.RecordBatch):
            ids, text = batch.column(0), batch.column(1)
            for lo, hi, buf, offsets in spans.slices(text):
                cols, texts = _judge(buf, offsets, rules, cleaned)
                arrays = [ids.slice(lo, hi - lo)] + [pa.array(c if c.dtype == bool else c.astype(np.int64)) for c in cols]
                names = [c.split()[0] for c in SCHEMA.split(", ")]
                if cleaned:
                    own = text.slice(lo, hi - lo)
                    changed = pa.array([t is not None for t in texts])
                    new = pa.array(texts, pa.string())
                    arrays += [pc.if_else(changed, new, own.cast(pa.string())), changed]
                    names += ["text", "text_changed"]
                yield pa.RecordBatch.from_arrays(arrays, names)

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, SCHEMA + (", text string, text_changed boolean" if cleaned else ""))


def clean_documents(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; the lines that fail are gone from their text.

    A column n_chars, if there is one, follows the new text.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def make():
        def f(batch: pa.RecordBatch):
            text = batch.column(at)
            for lo, hi, buf, offsets in spans.slices(text):
                cols, texts = _judge(buf, offsets, rules, True)
                kept = pa.array(cols[6])
                changed = pa.array([t is not None for t in texts])
                new = pc.if_else(changed, pa.array(texts, pa.string()), text.slice(lo, hi - lo).cast(pa.string()))
                arrays = [c.slice(lo, hi - lo) for c in batch.columns]
                arrays[at] = new.cast(batch.schema.field(at).type)
                if chars is not None:
                    arrays[chars] = pc.if_else(changed, pc.utf8_length(new).cast(batch.schema.field(chars).type), arrays[chars])
                yield pa.RecordBatch.from_arrays(arrays, batch.schema.names).filter(kept)

        return f

    return map_rows(docs, make)
