"""Language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes. Filters of several widths
run over the bytes of a window; their maxima go through a softmax layer. The
network is trained in numpy on a bounded sample of the windows of all labelled texts;
a text's language is that of the mean log-probability over all its bytes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import held_out, map_batches


@dataclass(frozen=True)
class CnnRules:
    """The network is trained on about ``sample`` different windows of each language at most, those of smallest hash
    among all windows of all labelled texts."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    sample: int = 3_000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.01
    seed: int = 7


@dataclass
class ByteCnn:
    languages: list[str]
    rules: CnnRules
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], rules: CnnRules) -> ByteCnn:
        rng = np.random.default_rng(rules.seed)
        w = {"emb": rng.normal(0, 0.5, (256, rules.embedding))}
        w["emb"][0] = 0  # what a short window is filled up with
        for k in rules.widths:
            w[f"conv{k}"] = rng.normal(0, 1 / np.sqrt(k * rules.embedding), (k * rules.embedding, rules.filters))
            w[f"bias{k}"] = np.zeros(rules.filters)
        w["out"] = rng.normal(0, 0.1, (len(rules.widths) * rules.filters, len(languages)))
        w["out_bias"] = np.zeros(len(languages))
        return cls(languages, rules, {k: v.astype(np.float32) for k, v in w.items()})

    def _pooled(self, x: np.ndarray):
        """Maxima over positions of each filter, where they lie, and the embedded bytes."""
        r, w = self.rules, self.weights
        e = w["emb"][x]  # (n, window, embedding)
        n, size, dim = e.shape
        maxima, places = [], []
        for k in r.widths:
            view = np.lib.stride_tricks.as_strided(e, (n, size - k + 1, k * dim), (e.strides[0], e.strides[1], e.strides[2]))
            y = (np.ascontiguousarray(view).reshape(-1, k * dim) @ w[f"conv{k}"]).reshape(n, size - k + 1, -1)
            at = y.argmax(axis=1) if self.training else None
            top = y.max(axis=1) + w[f"bias{k}"]
            maxima.append(np.maximum(top, 0))
            places.append((at, top > 0))
        return np.concatenate(maxima, axis=1), places, e

    training = False

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self._pooled(x)[0] @ self.weights["out"] + self.weights["out_bias"]
        z = z - z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on the cross-entropy of windows ``x`` and languages ``y``."""
        r, w = self.rules, self.weights
        rng = np.random.default_rng(r.seed + 1)
        first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        step = 0
        self.training = True
        for _ in range(r.epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), r.batch):
                rows = order[lo : lo + r.batch]
                grads = self._gradients(x[rows], y[rows])
                step += 1
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    w[k] -= (r.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        self.training = False

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        r, w = self.rules, self.weights
        pooled, places, e = self._pooled(x)
        z = pooled @ w["out"] + w["out_bias"]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        grads = {"out": pooled.T @ p, "out_bias": p.sum(axis=0)}
        back = p @ w["out"].T
        d_emb = np.zeros_like(w["emb"])
        n, dim = len(x), r.embedding
        rows = np.arange(n)
        for b, k in enumerate(r.widths):
            at, on = places[b]
            g = back[:, b * r.filters : (b + 1) * r.filters] * on
            grads[f"bias{k}"] = g.sum(axis=0)
            where = at[:, :, None] + np.arange(k)  # bytes under each filter's maximum
            seen = e[rows[:, None, None], where].reshape(n, r.filters, k * dim)
            grads[f"conv{k}"] = np.einsum("nfd,nf->df", seen, g)
            d = (g[:, :, None] * w[f"conv{k}"].T[None]).reshape(n, r.filters, k, dim)
            np.add.at(d_emb, x[rows[:, None, None], where], d)
        d_emb[0] = 0
        grads["emb"] = d_emb
        return grads


def byte_windows(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, one after the other, and the text of each; the last one of a text is filled up with 0."""
    length = np.diff(offsets)
    n = -(-length // size)
    doc = np.repeat(np.arange(len(length)), n)
    start = offsets[:-1][doc] + size * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
    at = start[:, None] + np.arange(size)
    inside = at < offsets[1:][doc][:, None]
    out = np.where(inside, np.append(buf, np.uint8(0))[np.minimum(at, len(buf))], np.uint8(0))
    return out, doc


def fit(docs: DataFrame, rules: CnnRules = CnnRules(), *, modulus: int = 4, remainder: int = 2) -> ByteCnn:
    """Train on the text and lang of documents whose id's crc32 hasn't the remainder; null or empty ones teach nothing.

    The different windows of each language are counted first, by a sketch; then each has the
    same chance, by its hash, wherever it lies in a text. Equal windows of a language are one, so
    a text that repeats doesn't crowd out others. The driver gets one row for each language
    and the sample. Without any labelled text the network knows no language.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id", modulus, remainder))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def windows(batch: pa.RecordBatch):
        """(languages of the rows, windows, their rows, their hashes as numbers below 1) of each slice of a batch."""
        for lo, hi, buf, offsets in spans.slices(batch.column(1)):
            x, doc = byte_windows(buf, offsets, rules.window)
            edge = np.arange(len(x) + 1) * rules.window
            yield batch.column(0).slice(lo, hi - lo), x, doc, (spans.hash_spans(x.ravel(), edge[:-1], edge[1:]) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    def hashes():
        def f(batch: pa.RecordBatch):
            for lang, _, doc, luck in windows(batch):
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(doc)), pa.array(luck)], ["lang", "luck"])

        return f

    sizes = map_batches(known, hashes, "lang string, luck double").groupBy("lang").agg(F.approx_count_distinct("luck", 0.02).alias("n")).collect()
    share = {r.lang: min(1.0, rules.sample / r.n) for r in sizes}

    def chosen():
        def f(batch: pa.RecordBatch):
            for lang, x, doc, luck in windows(batch):
                chance = np.array([share[c] for c in lang.to_pylist()])
                rows = np.flatnonzero(luck < chance[doc])
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(doc[rows])), pa.array([r.tobytes() for r in x[rows]], pa.binary())], ["lang", "window"])

        return f

    got = map_batches(known, chosen, "lang string, window binary").distinct().toArrow().sort_by([("lang", "ascending"), ("window", "ascending")])
    names = got.column(0).to_pylist()
    languages = sorted(set(names))
    model = ByteCnn.fresh(languages or ["und"], rules)
    if languages:
        index = {c: i for i, c in enumerate(languages)}
        x = np.frombuffer(b"".join(got.column(1).to_pylist()), np.uint8).reshape(-1, rules.window)
        model.train(x, np.array([index[c] for c in names]))
    return model


def identify(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text).

    All windows of the whole text vote with their log-probabilities, each with the
    weight of its bytes; score is the mean vote's probability. A text that is null or has no letter is ``und``, score 0,
    and so are all texts if no language is known. Rows that repeat get the same result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = pa.array(m.languages)

        def f(batch: pa.RecordBatch):
            text = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            letters = pc.match_substring_regex(text, r"\pL").to_numpy(zero_copy_only=False) & (m.languages != ["und"])
            for lo, hi, buf, offsets in spans.slices(text, 1 << 20):
                votes = np.zeros((hi - lo, len(m.languages)))
                x, doc = byte_windows(buf, offsets, m.rules.window)
                for a in range(0, len(x), 256):
                    size = np.count_nonzero(x[a : a + 256], axis=1)
                    np.add.at(votes, doc[a : a + 256], m.log_probabilities(x[a : a + 256]) * size[:, None])
                votes /= np.maximum(1, np.diff(offsets))[:, None]
                p = np.exp(votes - votes.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                some = pa.array(letters[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pc.if_else(some, names.take(pa.array(best)), "und"), pa.array(np.where(letters[lo:hi], p.max(axis=1), 0.0))], ["doc_id", "lang_pred", "score"])

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, lang_pred string, score double")
