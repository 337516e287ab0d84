"""Toxicity by class-conditional Kneser-Ney models.

For toxic and for ordinary texts there are two interpolated Kneser-Ney models
each: of the letters of a word, and of a word after the one before it, which sees
expressions whose words are harmless by themselves. Both classes back off to the same
lower-order distributions, made of continuation counts over all labelled texts,
so an expression that is rare in either class is smoothed by what both know;
what follows a known context for the first time gets both classes' back-off
weights. The difference of the two log-likelihoods is divided by the length of
what it is taken over: of windows of one to eight words, of which a text's worst
count, and of the whole text. A logistic curve, whose weights of these ratios
can't be negative, turns them into a probability; it is fitted to texts scored by models that haven't seen them.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import arrow_map, forget, held_out, map_batches, map_rows, settle

U64 = np.uint64
#: White space and ASCII marks stand between words.
_INK = np.ones(256, bool)
_INK[: ord("0")] = False
_INK[0x3A:0x41] = _INK[0x5B:0x61] = _INK[0x7B:0x80] = False
_BEGIN, _END = 2, 3


@dataclass(frozen=True)
class ToxicRules:
    """At most ``sample`` labelled documents of each class are learned from, by one text each: those of smallest id hash
    whose texts together have ``sample_bytes`` at most. All their n-grams are kept. ``folds`` parts of them are scored by what the
    others teach, for the curve, in which a toxic text counts as ``toxic_weight`` ordinary ones. Of windows of ``windows`` words
    (of word pairs: ``chains``) the ``worst`` ones of a text are averaged."""

    order: int = 7
    discount: float = 0.75
    strength: float = 20.0
    sample: int = 4_000
    sample_bytes: int = 16 << 20
    folds: int = 4
    toxic_weight: float = 3.0
    ridge: float = 0.001
    windows: tuple[int, ...] = (1, 2, 4, 8)
    chains: tuple[int, ...] = (1, 2)
    worst: int = 3

    @property
    def n_ratios(self) -> int:
        return len(self.windows) + 1 + len(self.chains)


@dataclass
class ClassRatios:
    """Of one Kneser-Ney model of both classes: ``grams``, symbols of ``width`` bits packed in 64, ascending, with their
    log-likelihood ratios; ``contexts`` are all but their last symbol, with the ratios of the classes' back-off weights."""

    grams: np.ndarray
    gram_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    width: int = 8

    @classmethod
    def empty(cls, width: int = 8) -> ClassRatios:
        return cls(np.zeros(0, U64), np.zeros(0, np.float32), np.zeros(0, U64), np.zeros(0, np.float32), width)

    def ratios(self, gram: np.ndarray) -> np.ndarray:
        """log P(symbol | context, toxic) - log P(symbol | context, ordinary) of n-grams.

        An unseen symbol after a known context is left to the shared model by
        both classes, so the ratio is that of their back-off weights; after an unknown context it is 0.
        """
        out = np.zeros(len(gram))
        for known, value, wanted in ((self.contexts, self.context_ratio, gram >> U64(self.width)), (self.grams, self.gram_ratio, gram)):
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                seen = known[at] == wanted
                out[seen] = value[at[seen]]
        return out


@dataclass(frozen=True)
class StoredRatios:
    """Ratios of word pairs and of their first words in Parquet folders of the shared folder: the columns ``column`` beside the keys."""

    pairs: str
    contexts: str
    column: str

    def load(self) -> ClassRatios:
        """Read by each worker process, which keeps the last one."""
        if self not in _LOADED:
            _LOADED.clear()
            found = []
            for folder, key in ((self.pairs, "gram"), (self.contexts, "context")):
                fs, root = pafs.FileSystem.from_uri(folder)
                files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))
                parts = [pq.read_table(f, columns=[key, self.column], filesystem=fs) for f in files]
                keys, values = (np.concatenate([t.column(c).to_numpy() for t in parts]) for c in (key, self.column))
                keys, values = keys[~np.isnan(values)].view(U64), values[~np.isnan(values)]
                order = np.argsort(keys)
                found += [keys[order], values[order]]
            _LOADED[self] = ClassRatios(*found, 32)
        return _LOADED[self]


_LOADED: dict[StoredRatios, ClassRatios] = {}


@dataclass
class ToxicModel:
    """``curve``: bias, a weight for each ratio in the order of ``text_features``, and one for the log of the length."""

    letters: ClassRatios
    pairs: StoredRatios | None
    curve: np.ndarray
    rules: ToxicRules

    @classmethod
    def ignorant(cls, rules: ToxicRules) -> ToxicModel:
        """A model that scores all texts alike, low."""
        return cls(ClassRatios.empty(8), None, np.concatenate([[-3.0], np.zeros(rules.n_ratios + 1)]), rules)


def _ink_words(column: pa.Array, limit: int):
    """Runs of letters and digits, lower-cased: (first row, end row, bytes, starts, ends, words per text)."""
    lowered = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    for lo, hi, buf, offsets in spans.slices(lowered, limit):
        clean = np.where(_INK[buf], buf, np.uint8(32))
        yield lo, hi, clean, *spans.words(clean, offsets)


def letter_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram of ``order`` bytes ending there) for each byte of each word and its end mark.

    An n-gram that reaches before the word holds begin marks. The newest byte is the lowest.
    """
    size = ends - starts + 1
    word = np.repeat(np.arange(len(starts)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    symbol = np.append(buf, np.uint8(0))[starts[word] + place].astype(U64)
    symbol[np.cumsum(size) - 1] = _END
    gram = symbol.copy()
    for k in range(1, order):
        before = np.full(len(word), _BEGIN, U64)
        inside = np.flatnonzero(place >= k)
        before[inside] = symbol[inside - k]
        gram |= before << U64(8 * k)
    return word, gram


def word_pairs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each word after the one before it in its text, or after a begin mark: two 32-bit hashes in 64 bits."""
    word = hashes >> U64(32)
    before = np.empty(len(word), U64)
    before[1:] = word[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 1
    return before << U64(32) | word


def kneser_ney(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, rules: ToxicRules, *, order: int | None = None, width: int = 8) -> ClassRatios:
    """Log-likelihood ratios of full n-grams and of the back-off weights of their contexts, from counts in both classes.

    The shared model is interpolated Kneser-Ney over the counts of both
    classes, with continuation counts below the full order; all symbols, of bytes 256 and of words those known, are alike below it. Each class discounts
    its own counts and backs off to it: ``strength`` more counts of the shared
    model stand behind every context.
    """
    d, order = rules.discount, order or rules.order
    pooled = toxic + ordinary
    kinds: list[tuple[np.ndarray, np.ndarray]] = []  # (shorter n-gram, different n-grams one longer that end in it)
    above = grams
    for k in range(order - 1, 0, -1):
        above, n = np.unique(above & U64((1 << (width * k)) - 1), return_counts=True)
        kinds.append((above, n))
    shorter, prob = np.zeros(1, U64), np.full(1, 1 / (256 if width == 8 else len(above) + 1))
    for k, (gram, n) in enumerate([*reversed(kinds), (grams, pooled)], 1):
        _, back = np.unique(gram >> U64(width), return_inverse=True)
        total, types = np.bincount(back, weights=n)[back], np.bincount(back)[back]
        lower = prob[np.searchsorted(shorter, gram & U64((1 << (width * (k - 1))) - 1))]
        shorter, prob = gram, (np.maximum(n - d, 0) + d * types * lower) / total
    contexts, back = np.unique(grams >> U64(width), return_inverse=True)
    logs, weights = [], []
    for n in (toxic, ordinary):
        total, types = np.bincount(back, weights=n), np.bincount(back, weights=n > 0)
        rest = d * types + rules.strength
        logs.append(np.log((np.maximum(n - d, 0) + rest[back] * prob) / (total[back] + rules.strength)))
        weights.append(np.log(rest / (total + rules.strength)))
    return ClassRatios(grams, (logs[0] - logs[1]).astype(np.float32), contexts, (weights[0] - weights[1]).astype(np.float32), width)


class WordRatios:
    """Log-likelihood ratios of words by their letters; a worker keeps those it has met, up to a bound."""

    def __init__(self, model: ToxicModel, capacity: int = 1_000_000):
        self.model, self.capacity = model, capacity
        self.hashes, self.ratios = np.zeros(0, U64), np.zeros(0)

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.append(self.hashes, U64(0))[at] == distinct
        known &= at < len(self.hashes)
        value = np.zeros(len(distinct))
        value[known] = self.ratios[at[known]]
        if not known.all():
            new = first[~known]
            value[~known] = self._score(buf, starts[new], ends[new])
            if len(self.hashes) + len(new) > self.capacity:
                self.hashes, self.ratios = distinct, value.copy()
            else:
                self.hashes = np.insert(self.hashes, at[~known], distinct[~known])
                self.ratios = np.insert(self.ratios, at[~known], value[~known])
        return value[back]

    def _score(self, buf, starts, ends) -> np.ndarray:
        word, gram = letter_grams(buf, starts, ends, self.model.rules.order)
        return np.bincount(word, weights=self.model.letters.ratios(gram), minlength=len(starts))


def worst_windows(ratios: np.ndarray, counts: np.ndarray, size: int, worst: int) -> np.ndarray:
    """Of each text, the mean of its ``worst`` highest windows of ``size`` words, each its ratio by word.

    Words that a text lacks for a window, and windows that it lacks, count 0.
    """
    total = np.zeros(len(ratios) + 1)
    np.cumsum(ratios, out=total[1:])
    some = np.flatnonzero(counts)
    n = np.maximum(counts[some] - size + 1, 1)  # windows of each text with words
    begin = (np.cumsum(counts) - counts)[some]
    first = np.cumsum(n) - n
    at = np.repeat(begin - first, n) + np.arange(int(n.sum()))
    stop = np.minimum(at + size, np.repeat(begin + counts[some], n))
    value = (total[stop] - total[at]) / size
    out = np.zeros(len(counts))
    for k in range(worst if len(some) else 0):
        high = np.maximum.reduceat(value, first)
        left = n > k
        out[some[left]] += high[left] / worst
        # the first window that has it is taken out
        text = np.repeat(np.arange(len(n)), n)
        hit = np.flatnonzero(value == high[text])
        value[hit[np.unique(text[hit], return_index=True)[1]]] = -np.inf
    return out


def text_features(letters: np.ndarray, pairs: np.ndarray, counts: np.ndarray, rules: ToxicRules) -> np.ndarray:
    """(texts, ratios and 1): the worst windows of each length by letters, the whole text by word, the worst windows by word pairs, the log of the length."""
    doc = np.repeat(np.arange(len(counts)), counts)
    whole = np.bincount(doc, weights=letters, minlength=len(counts)) / np.maximum(counts, 1)
    columns = [worst_windows(letters, counts, m, rules.worst) for m in rules.windows]
    return np.column_stack([*columns, whole, *(worst_windows(pairs, counts, m, rules.worst) for m in rules.chains), np.log1p(counts)])


def _scorer(model: ToxicModel):
    """A function of a text column: runs of rows (first, end) with their features."""
    words = WordRatios(model)
    pairs = model.pairs.load() if model.pairs else ClassRatios.empty(32)

    def run(column: pa.Array):
        for lo, hi, buf, starts, ends, counts in _ink_words(column, 1 << 20):
            hashes = spans.hash_spans(buf, starts, ends)
            yield lo, hi, text_features(words.of(buf, starts, ends, hashes), pairs.ratios(word_pairs(hashes, counts)), counts, model.rules)

    return run


def probability(curve: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30)))


def _features(texts: DataFrame, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of the sample's (toxic, text), on the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    n = model.rules.n_ratios + 1

    def make():
        score = _scorer(shared.value)

        def f(batch: pa.RecordBatch):
            for lo, hi, x in score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, x.T.copy())], ["toxic", *(f"x{k}" for k in range(n))])

        return f

    seen = map_batches(texts, make, "toxic int, " + ", ".join(f"x{k} double" for k in range(n))).toArrow()
    shared.destroy()
    return np.column_stack([seen.column(k + 1).to_numpy() for k in range(n)]), seen.column(0).to_numpy().astype(float)


def fit_curve(x: np.ndarray, y: np.ndarray, rules: ToxicRules) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge; (bias, weights).

    The weights of the ratios can't be negative: one that would be is set to 0
    and the others are fitted again. The last column, the length, may have any weight.
    """
    curve = ToxicModel.ignorant(rules).curve
    if not len(y) or y.min() == y.max():
        return curve
    mid, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mid) / scale])
    each = np.where(y == 1, rules.toxic_weight, 1.0)
    active = list(range(z.shape[1]))
    while True:
        a, w = z[:, active], np.zeros(len(active))
        ridge = np.where(np.array(active) == 0, 1e-6, rules.ridge) * len(y)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = a.T @ (a * (each * p * (1 - p))[:, None]) + np.diag(ridge + 1e-9)
            w = w - np.clip(np.linalg.solve(h, a.T @ (each * (p - y)) + ridge * w), -3, 3)
        lowest = min((v, k) for v, k in zip(w.tolist(), active, strict=True) if 0 < k < z.shape[1] - 1) if len(active) > 2 else (0.0, 0)
        if lowest[0] >= 0:
            break
        active.remove(lowest[1])
    full = np.zeros(z.shape[1])
    full[active] = w
    return np.concatenate([[full[0] - (full[1:] * mid / scale).sum()], full[1:] / scale])


def _sample(docs: DataFrame, labels: DataFrame, rules: ToxicRules, modulus: int, remainder: int) -> DataFrame:
    """(fold, toxic, text) of the documents to learn from, written."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id", modulus, remainder))
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda c: usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.sample)
    chosen = F.broadcast(pick(0).union(pick(1)))  # two times rules.sample rows at most
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = texts.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.max(F.octet_length("text")).alias("size"))
    seen = sorted((r.toxic, r.hash, r.doc_id, r.size) for r in sizes.select("toxic", F.xxhash64("doc_id").alias("hash"), "doc_id", "size").collect())  # two times rules.sample rows at most
    ids = []
    for c in (0, 1):
        mine = [r for r in seen if r[0] == c]
        ids += [(r[2], c) for r, total in zip(mine, accumulate(r[3] for r in mine), strict=True) if total <= rules.sample_bytes]
    within = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    own = texts.join(F.broadcast(within), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return settle(own.select(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(rules.folds)).cast("int").alias("fold"), "toxic", "text"), "toxic")


def _counts(texts: DataFrame, rules: ToxicRules) -> DataFrame:
    """(pair, gram, n0, n1, ...): of letters and of word pairs, how often each n-gram occurs in each fold, first in toxic, then in ordinary texts."""
    cells = 2 * rules.folds

    def count(batches):
        for batch in batches:
            fold, toxic = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, buf, starts, ends, counts in _ink_words(batch.column(2), 1 << 20):
                cell = np.repeat(np.where(toxic[lo:hi] == 1, fold[lo:hi], rules.folds + fold[lo:hi]), counts)
                word, gram = letter_grams(buf, starts, ends, rules.order)
                for kind, grams, at in ((False, gram, cell[word]), (True, word_pairs(spans.hash_spans(buf, starts, ends), counts), cell)):
                    both, back = np.unique(grams, return_inverse=True)
                    n = np.bincount(back * cells + at, minlength=len(both) * cells).reshape(-1, cells).astype(np.int32)
                    for k in range(0, len(both), 100_000):
                        part = slice(k, k + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both[part]), kind)), pa.array(both[part].view(np.int64)), *map(pa.array, n[part].T.copy())], ["pair", "gram", *(f"n{c}" for c in range(cells))])

    names = [f"n{c}" for c in range(cells)]
    found = arrow_map(texts, count, "pair boolean, gram long, " + ", ".join(f"{c} int" for c in names))
    return found.groupBy("pair", "gram").agg(*(F.sum(c).cast("int").alias(c) for c in names))


def pair_ratios(table: DataFrame, rules: ToxicRules) -> tuple[DataFrame, DataFrame]:
    """(gram, r0, r1, ..., all) and (context, r0, r1, ..., all): ``kneser_ney`` of word pairs, without each fold and of all, as two joins.

    NaN where a pair or a first word occurs in none of the texts.
    """
    d, models = rules.discount, [*range(rules.folds), None]
    names = [f"r{k}" for k in range(rules.folds)] + ["all"]
    counts = {}
    for name, without in zip(names, models, strict=True):
        keep = [k for k in range(rules.folds) if k != without]
        counts[f"t_{name}"] = sum((F.col(f"n{k}") for k in keep[1:]), F.col(f"n{keep[0]}"))
        counts[f"o_{name}"] = sum((F.col(f"n{rules.folds + k}") for k in keep[1:]), F.col(f"n{rules.folds + keep[0]}"))
    grams = table.select("gram", F.shiftrightunsigned("gram", 32).alias("context"), F.col("gram").bitwiseAND(0xFFFFFFFF).alias("word"), *[f"n{k}" for k in range(2 * rules.folds)])
    n = lambda c, m: counts[f"{c}_{m}"] if c in "to" else F.col(f"{c}_{m}")
    there = lambda m: n("t", m) + n("o", m) > 0
    words = grams.groupBy("word").agg(*(F.count_if(there(m)).cast("int").alias(f"kinds_{m}") for m in names))
    whole = words.agg(*(F.sum(f"kinds_{m}").alias(f"all_{m}") for m in names), *(F.count_if(F.col(f"kinds_{m}") > 0).alias(f"words_{m}") for m in names))
    after = grams.groupBy("context").agg(
        *(F.count_if(there(m)).cast("int").alias(f"types_{m}") for m in names),
        *(F.sum(n(c, m)).cast("int").alias(f"total_{c}_{m}") for m in names for c in "to"), *(F.count_if(n(c, m) > 0).cast("int").alias(f"types_{c}_{m}") for m in names for c in "to"),
    )
    rest = lambda c, m: F.lit(d) * F.col(f"types_{c}_{m}") + rules.strength
    both = grams.join(words, "word").join(after, "context").crossJoin(whole)  # the last of one row
    known = lambda m, c: F.when(m, c).otherwise(float("nan")).cast("float")
    out = []
    for m in names:
        lower = (F.greatest(n("kinds", m) - d, F.lit(0.0)) + d * n("words", m) / (n("words", m) + 1)) / n("all", m)
        shared = (F.greatest(n("t", m) + n("o", m) - d, F.lit(0.0)) + d * n("types", m) * lower) / (n("total_t", m) + n("total_o", m))
        log = {c: F.log((F.greatest(n(c, m) - d, F.lit(0.0)) + rest(c, m) * shared) / (F.col(f"total_{c}_{m}") + rules.strength)) for c in "to"}
        out.append(known(there(m), log["t"] - log["o"]).alias(m))
    weight = lambda c, m: F.log(rest(c, m) / (F.col(f"total_{c}_{m}") + rules.strength))
    return both.select("gram", *out), after.select("context", *(known(n("types", m) > 0, weight("t", m) - weight("o", m)).alias(m) for m in names))


def _folder(df: DataFrame) -> str:
    """The folder of a settled frame as a URI."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def _models(table: DataFrame, rules: ToxicRules):
    """A function of the fold to leave out (or None) that gives a model. The letters' counts, which the sample bounds, come to the driver, the pairs' ratios stay in the shared folder."""
    rows = table.where(~F.col("pair")).drop("pair").toArrow()
    grams = rows.column(0).to_numpy().view(U64)
    order = np.argsort(grams)
    grams, n = grams[order], [c.to_numpy()[order] for c in rows.columns[1:]]
    del rows
    stored = [settle(df, name) for df, name in zip(pair_ratios(table.where("pair").drop("pair"), rules), ("pairs", "contexts"), strict=True)] if len(grams) else []

    def make(without: int | None) -> ToxicModel:
        model = ToxicModel.ignorant(rules)
        keep = [k for k in range(rules.folds) if k != without]
        toxic, ordinary = (sum(n[shift + k].astype(np.float64) for k in keep) if len(grams) else np.zeros(0) for shift in (0, rules.folds))
        if toxic.any() and ordinary.any():
            some = toxic + ordinary > 0
            model.letters = kneser_ney(grams[some], toxic[some], ordinary[some], rules)
            model.pairs = StoredRatios(*map(_folder, stored), "all" if without is None else f"r{without}")
        return model

    return make


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicRules = ToxicRules(), *, modulus: int = 3, remainder: int = 1) -> ToxicModel:
    """Learn from (doc_id, text) and (doc_id, toxic), leaving out ids whose crc32 has the remainder.

    What reaches the driver are the letters' n-grams of the sample, which its bytes bound; those of words stay in files of the shared folder, which the model needs. Labels that are
    null or not 0 or 1 are ignored; of several labels of a document the largest
    counts, of several texts of one id that of the smallest hash. Without labels of both classes the model
    scores all texts alike, low.
    """
    texts = _sample(docs, labels, rules, modulus, remainder)
    dealt = texts.repartition(max(4, len(texts.inputFiles())))
    table = settle(_counts(dealt, rules), "grams")
    make = _models(table, rules)
    model = make(None)
    if len(model.letters.grams):
        seen = [_features(dealt.where(F.col("fold") == k).select("toxic", "text"), make(k)) for k in range(rules.folds)]
        model.curve = fit_curve(np.concatenate([x for x, _ in seen]), np.concatenate([y for _, y in seen]), rules)
    forget(texts, table)
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, *, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, text); null and empty texts get the score of no evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        score = _scorer(shared.value)

        def f(batch: pa.RecordBatch):
            for lo, hi, x in score(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(probability(shared.value.curve, x))], ["doc_id", "score"])

        return f

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(rows, make, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicModel, *, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        score = _scorer(shared.value)

        def f(batch: pa.RecordBatch):
            for lo, hi, x in score(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(probability(shared.value.curve, x) < threshold))

        return f

    return map_rows(docs, make)
