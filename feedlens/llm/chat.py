"""Chat formatting: transcripts are parsed by a hidden Markov model, then rendered as canonical turns.

A transcript is a sequence of lines. The hidden states are the roles, each as
the first line of a turn or as a line inside one; lines are observed by a
speaker marker at their start, their length, question marks, list and code
marks. The most likely states are found by Viterbi and lines of one turn are
merged. Long transcripts are decoded in chunks: the best score between every pair
of states at both ends of a chunk is a small matrix. Matrices are joined along
the transcript in two steps, inside ranges of chunks and then over the ranges,
and each chunk is then decoded between its fixed ends, so no task holds more of a transcript than a range of its chunks.
Many transcripts are decoded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, settle

#: Speaker markers of each role, at the start of a line.
MARKERS = {
    "system": r"(?i)^\s*(?:\[?(?:system|instructions?)\]?|<\|?system\|?>)\s*[:>]\s*",
    "user": r"(?i)^\s*(?:\[?(?:user|human|q|question|customer|me)\]?|<\|?(?:user|human)\|?>)\s*[:>]\s*",
    "assistant": r"(?i)^\s*(?:\[?(?:assistant|bot|ai|a|answer|agent)\]?|<\|?(?:assistant|bot)\|?>)\s*[:>]\s*",
}
ROLES = tuple(MARKERS)
#: State r begins a turn of role r, state S + r continues it.
S = len(ROLES)
N_LENGTHS = 10
N_SIGNALS = 4


@dataclass(frozen=True)
class ChatRules:
    """``smoothing`` is added to all counts; a chunk holds ``places`` places, a place of over ``crowd`` different rows is dealt into more of them."""

    smoothing: float = 0.5
    places: int = 64
    crowd: int = 256


@dataclass
class ChatModel:
    """Log-probabilities of states: first, next, and of what is seen of a line."""

    start: np.ndarray
    move: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    signal: np.ndarray
    rules: ChatRules


def _marker(text: Column) -> Column:
    """0 for none, else 1 + the role's number."""
    out = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES))):
        out = F.when(text.rlike(MARKERS[role]), k + 1).otherwise(out)
    return out


def _lines(text: Column) -> Column:
    """The lines of a text that aren't blank."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))


def features(rows: DataFrame) -> DataFrame:
    """Adds marker, length (a bin of its logarithm) and signal (question mark, list or code) to (..., text) of lines."""
    text = F.col("text")
    length = F.least(F.lit(N_LENGTHS - 1), F.floor(F.log2(F.length(text) + 1)).cast("int"))
    signal = F.when(text.contains("?"), 1).otherwise(0) + F.when(text.rlike(r"^\s*(?:[-*•]\s|\d+[.)]\s|```)"), 2).otherwise(0)
    return rows.withColumns({"marker": _marker(text), "length": length, "signal": signal})


def fit(turns: DataFrame, rules: ChatRules = ChatRules()) -> ChatModel:
    """Count states, moves and features over all turns (conv_id, turn, role, text) with a known role and a line that isn't blank.

    ``text`` stands as in a transcript, speaker markers included. The driver gets
    tables whose size depends on the numbers of states and bins alone. A move
    from turn to turn is counted to the turn numbered next in its conversation.
    """
    number = F.create_map(*[x for k, r in enumerate(ROLES) for x in (F.lit(r), F.lit(k))])
    known = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), number[F.lower("role")].alias("state"), _lines(F.col("text").cast("string")).alias("lines"))
    known = known.where("state is not null and size(lines) > 0").withColumn("n", F.size("lines"))
    marker, length, signal = (np.full((2 * S, n), rules.smoothing) for n in (S + 1, N_LENGTHS, N_SIGNALS))
    lines = known.select("state", F.posexplode("lines").alias("at", "text")).withColumn("state", F.col("state") + F.when(F.col("at") > 0, S).otherwise(0))
    for r in features(lines).groupBy("state", "marker", "length", "signal").count().collect():
        marker[r.state, r.marker] += r["count"]
        length[r.state, r.length] += r["count"]
        signal[r.state, r.signal] += r["count"]
    start, move = np.full(2 * S, -np.inf), np.full((2 * S, 2 * S), 0.0)
    start[:S] = rules.smoothing
    move[:, :S] = rules.smoothing
    role = np.arange(S)
    move[role, S + role] = move[S + role, S + role] = rules.smoothing
    for r in known.groupBy("state").agg(F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).alias("first"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("go"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("on")).collect():
        start[r.state] += r.first
        move[r.state, S + r.state] += r.go
        move[S + r.state, S + r.state] += r.on
    one = known.select("conv_id", (F.col("state") + F.when(F.col("n") > 1, S).otherwise(0)).alias("a"), (F.col("turn") + 1).alias("turn"))
    two = known.select("conv_id", F.col("state").alias("b"), "turn")
    one, two = (x.groupBy(*x.columns).count().withColumnRenamed("count", f"n{k}") for k, x in enumerate((one, two)))  # repeated rows count once a side
    for r in one.join(two, ["conv_id", "turn"]).groupBy("a", "b").agg(F.sum(F.col("n0") * F.col("n1")).alias("n")).collect():
        move[r.a, r.b] += r.n
    with np.errstate(divide="ignore"):
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return ChatModel(norm(np.where(np.isinf(start), 0, start)), norm(move), norm(marker), norm(length), norm(signal), rules)


def emissions(model: ChatModel, t: pa.Table) -> np.ndarray:
    """(lines, states) log-probabilities of what is seen of each line."""
    marker, length, signal = (t.column(c).to_numpy() for c in ("marker", "length", "signal"))
    return model.marker[:, marker].T + model.length[:, length].T + model.signal[:, signal].T


def viterbi(emit: np.ndarray, move: np.ndarray, first: np.ndarray, last: int | None = None) -> np.ndarray:
    """Most likely states; ``first`` are scores of the first state, ``last`` fixes the final one. Ties go to the lower state."""
    return viterbi_all(emit, np.array([len(emit)]), move, first[None], np.array([-1 if last is None else last]))


def viterbi_all(emit: np.ndarray, sizes: np.ndarray, move: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``viterbi`` of many sequences at once: their lines in a row, (sequences, states) scores of first states, and final states, -1 for any.

    Step k is taken for all sequences that have a line k, the longest ones first.
    """
    begin = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    begin, long = begin[order], sizes[order]
    score = first[order] + emit[begin]
    back = np.zeros(emit.shape, np.int8)
    for k in range(1, int(long[0]) if len(long) else 0):
        live = int(np.searchsorted(-long, -k, side="left"))  # sequences of more than k lines
        ways = score[:live, :, None] + move
        back[begin[:live] + k] = ways.argmax(axis=1)
        score[:live] = ways.max(axis=1) + emit[begin[:live] + k]
    state = np.where(last[order] < 0, score.argmax(axis=1), last[order])
    out = np.zeros(len(emit), np.int64)
    for k in range(int(long[0]) - 1 if len(long) else -1, -1, -1):
        live = int(np.searchsorted(-long, -k, side="left"))
        at = begin[:live] + k
        out[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return out


def chunk_ends(best: np.ndarray, move: np.ndarray, start: np.ndarray, stop: int | None) -> list[tuple[int, int]]:
    """The first and last state of each chunk on the best way through chunks in a row, whose (chunks, first, last) scores are ``best``."""
    score, back = start, []
    for k, m in enumerate(best):
        enter = np.full(len(start), -1)
        if k:
            ways = score[:, None] + move
            enter, score = ways.argmax(axis=0), ways.max(axis=0)
        ways = score[:, None] + m
        first, score = ways.argmax(axis=0), ways.max(axis=0)
        back.append((enter, first))
    state, found = int(score.argmax()) if stop is None else stop, []
    for enter, first in reversed(back):
        begin = int(first[state])
        found.append((begin, state))
        state = int(enter[begin])
    return found[::-1]


def joined_chunks(best: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The (first, last) scores through all chunks in a row: neighbours are joined pair by pair, as the join is associative."""
    while len(best) > 1:
        a, b = best[: len(best) // 2 * 2 : 2], best[1::2]
        step = (a[:, :, :, None] + move).max(axis=2)
        pairs = (step[:, :, :, None] + b[:, None]).max(axis=2)
        best = np.concatenate([pairs, best[len(best) // 2 * 2 :]])
    return best[0]


def _placed(parts: DataFrame, rules: ChatRules) -> DataFrame:
    """Lines (conv, conv_id, chunk, sub, place, hash, line, text, copies): different rows, dealt into chunks that keep their order."""
    text = F.col("text").cast("string")
    rows = parts.select("conv_id", F.coalesce(F.col("place").cast("long"), F.lit(-1)).alias("place"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.groupBy("conv_id", "place", "text").agg(F.count("*").alias("copies")).withColumn("hash", F.xxhash64("text"))
    rows = rows.withColumn("conv", F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string"))))
    rows = rows.withColumns({"chunk": F.floor(F.col("place") / rules.places), "sub": F.lit(0)})
    crowded = settle(rows.groupBy("conv", "place").count().where(F.col("count") > rules.crowd).select("conv", "place", F.ceil(F.col("count") / rules.crowd).cast("int").alias("m")), "crowded")
    if not crowded.isEmpty():  # places of many rows: a chunk for each range of hashes, and the other places of their chunk one by one
        salts = 32
        full = crowded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        chunks = crowded.select("conv", F.floor(F.col("place") / rules.places).alias("chunk")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("split", F.lit(1))
        rows = rows.withColumn("salt", F.pmod("hash", F.lit(salts)).cast("int")).join(full, ["conv", "place", "salt"], "left").join(chunks, ["conv", "chunk", "salt"], "left")
        share = F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(-(2**63))), 33)  # the upper 31 bits, in the order of the hash
        within = F.coalesce(F.floor(share * F.col("m") / F.lit(2**31)), F.lit(0)).cast("int")
        rows = rows.withColumn("sub", F.when(F.col("split").isNull(), 0).otherwise((F.col("place") - F.col("chunk") * rules.places + 1) * F.lit(1 << 24).cast("long") + within)).drop("salt", "m", "split")
    rows = rows.withColumn("sub", F.col("sub").cast("long"))
    lines = rows.select("conv", "conv_id", "chunk", "sub", "place", "hash", "copies", F.posexplode(_lines(F.col("text"))).alias("line", "text"))
    return features(lines)


def parse_transcripts(parts: DataFrame, model: ChatModel) -> DataFrame:
    """Turns (conv_id, turn, piece, role_pred, n_lines, n_rows, text, opens, closes) of the transcripts of (conv_id, place, text).

    A transcript is the lines of a conversation's rows, in the order of place,
    equal places by the text's hash. Nothing but that order and the lines is
    used: a row may hold several turns or a part of one. A null place counts
    as -1, a null text as empty; rows without conv_id form one transcript;
    blank lines are left out, so rows without any other line give nothing. Rows
    that are equal are read once; n_rows counts all rows whose first line lies
    in a turn. A turn that reaches over chunks comes in pieces, of which the
    first opens and the last closes it. Other columns are ignored.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    base = settle(_placed(parts, model.rules), "lines")
    key = ["conv", "chunk", "sub"]
    spread = base.groupBy("conv").agg(F.min(F.struct("chunk", "sub")).alias("low"), F.max(F.struct("chunk", "sub")).alias("high"))
    long = settle(spread.where("low <> high").select("conv"), "long")
    fixed = settle(_fixed_ends(base.join(long, "conv", "left_semi"), model), "fixed")
    shape = f"conv_id {kind}, conv string, chunk long, sub long, nth long, role_pred string, n_lines long, n_rows long, text string, opens boolean, closes boolean"
    columns = ["conv_id", *key, "line", "copies", "text", "marker", "length", "signal", "begin", "stop", "going"]
    dealt = base.join(fixed.drop("part"), key, "left").repartition(*key).sortWithinPartitions(*key, "place", "hash", "line").select(*columns)
    turns = settle(arrow_map(dealt, _decoder(model), shape), "turns")
    # pieces and turns before each chunk: inside its range of chunks, and before that range
    of = fixed.select(*key, "part")
    chunks = turns.join(of, key).groupBy(*key, "part").agg(F.max("nth").alias("n"))
    per = chunks.groupBy("conv", "part").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
    along, inside = Window.partitionBy("conv").orderBy("part"), Window.partitionBy("conv", "part").orderBy("chunk", "sub")
    per = per.select("conv", "part", (F.sum("n").over(along) - F.col("n")).alias("before_n"), (F.sum("m").over(along) - F.col("m")).alias("before_m"))
    before = chunks.select(*key, "part", (F.sum("n").over(inside) - F.col("n")).alias("own"), F.row_number().over(inside).alias("nth_chunk")).join(per, ["conv", "part"])
    before = before.select(*key, (F.col("own") + F.col("before_n")).alias("before"), (F.col("nth_chunk") + F.col("before_m")).alias("piece"))
    out = turns.join(before, key, "left").withColumn("turn", F.coalesce("before", F.lit(0)) + F.col("nth") - 1)
    return out.select("conv_id", "turn", F.coalesce("piece", F.lit(1)).cast("long").alias("piece"), "role_pred", "n_lines", "n_rows", "text", "opens", "closes")


def _fixed_ends(lines: DataFrame, model: ChatModel, *, range_chunks: int = 20_000, most_ranges: int = 10_000) -> DataFrame:
    """(conv, chunk, sub, part, begin, stop, going) of every chunk of long transcripts: its range of chunks, its first and last state, and whether its last turn goes on.

    Chunks are dealt by ranges of their order. Of a transcript there is one joined matrix for
    each range that it reaches into, ``most_ranges`` at most; the ends of these are found first, then those of the chunks between them.
    """
    n, key = 2 * S, ["conv", "chunk", "sub"]
    kinds = "conv string, chunk long, sub long"

    def matrix(t: pa.Table) -> pa.Table:
        emit = emissions(model, t.sort_by([("place", "ascending"), ("hash", "ascending"), ("line", "ascending")]))
        steps = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)[None] + emit[:, None, :]  # a line alone: from its state to itself
        best = joined_chunks(steps, model.move)
        return pa.table({c: t.column(c).slice(0, 1) for c in key} | {"best": pa.array([best.ravel().tolist()], pa.list_(pa.float64()))})

    def matrices(t: pa.Table) -> np.ndarray:
        return np.array(t.column("best").to_pylist()).reshape(-1, n, n)

    def total(t: pa.Table) -> pa.Table:
        best = joined_chunks(matrices(t.sort_by([("chunk", "ascending"), ("sub", "ascending")])), model.move)
        return pa.table({"conv": t.column("conv").slice(0, 1), "part": t.column("part").slice(0, 1), "best": pa.array([best.ravel().tolist()], pa.list_(pa.float64()))})

    def outer(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending")])
        begin, stop = zip(*chunk_ends(matrices(t), model.move, model.start, None), strict=True)
        after = pa.array([*begin[1:], None], pa.int32())
        return pa.table({"conv": t.column("conv"), "part": t.column("part"), "from": pa.array(begin, pa.int32()), "to": pa.array(stop, pa.int32()), "after": after})

    def inner(t: pa.Table) -> pa.Table:
        t = t.sort_by([("chunk", "ascending"), ("sub", "ascending")])
        first, last, after = (t.column(c)[0].as_py() for c in ("from", "to", "after"))
        begin, stop = zip(*chunk_ends(matrices(t), model.move, np.where(np.arange(n) == first, 0.0, -np.inf), last), strict=True)
        going = [b >= S for b in begin[1:]] + [after is not None and after >= S]
        return pa.table({c: t.column(c) for c in (*key, "part")} | {"begin": pa.array(begin, pa.int32()), "stop": pa.array(stop, pa.int32()), "going": pa.array(going)})

    pieces = settle(lines.groupBy(*key).applyInArrow(matrix, f"{kinds}, best array<double>"), "pieces")
    (count,) = pieces.agg(F.count("*")).first()
    ranges = max(1, min(-(-count // range_chunks), most_ranges))
    placed = settle(pieces.repartitionByRange(ranges, *key).withColumn("part", F.spark_partition_id()), "placed")
    ends = placed.groupBy("conv", "part").applyInArrow(total, "conv string, part int, best array<double>").groupBy("conv").applyInArrow(outer, "conv string, part int, from int, to int, after int")
    found = placed.join(ends, ["conv", "part"]).groupBy("conv", "part").applyInArrow(inner, f"{kinds}, part int, begin int, stop int, going boolean")
    return found


def _decoder(model: ChatModel, run_lines: int = 20_000):
    """A function for mapInArrow over lines in the order of their chunks: the turns of each chunk, many chunks at a time."""
    n = 2 * S

    def heads(t: pa.Table) -> np.ndarray:
        """Whether each line is the first of its chunk."""
        conv = t.column("conv").combine_chunks().dictionary_encode()
        conv = conv.combine_chunks() if isinstance(conv, pa.ChunkedArray) else conv
        code = [conv.indices.to_numpy(), t.column("chunk").to_numpy(), t.column("sub").to_numpy()]
        new = np.ones(len(t), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in code], axis=0)
        return new

    def decode(t: pa.Table) -> pa.RecordBatch:
        new = heads(t)
        head = np.flatnonzero(new)
        sizes = np.diff(np.append(head, len(t)))
        ends = [np.nan_to_num(t.column(c).to_numpy(zero_copy_only=False).astype(float)[head], nan=-1).astype(np.int64) for c in ("begin", "stop")]
        first = np.where(ends[0][:, None] < 0, model.start[None], np.where(np.arange(n) == ends[0][:, None], 0.0, -np.inf))
        states = viterbi_all(emissions(model, t), sizes, model.move, first, ends[1])
        opens = states < S
        cut = np.flatnonzero(opens | new)
        end = np.append(cut[1:], len(t))
        rows = np.where(t.column("line").to_numpy() == 0, t.column("copies").to_numpy(), 0)
        going = t.column("going").fill_null(False).to_numpy(zero_copy_only=False)
        last = np.append(new[end[:-1]], True)  # the last turn of its chunk
        before = np.cumsum(opens)
        nth = before - np.repeat(before[head] - opens[head], sizes)
        text = t.column("text").to_pylist()
        take = pa.array(cut)
        return pa.RecordBatch.from_arrays([
            *(t.column(c).combine_chunks().take(take) for c in ("conv_id", "conv", "chunk", "sub")), pa.array(nth[cut]), pa.array([ROLES[s % S] for s in states[cut].tolist()]), pa.array(end - cut),
            pa.array(np.add.reduceat(rows, cut)), pa.array(["\n".join(text[a:b]) for a, b in zip(cut.tolist(), end.tolist(), strict=True)]), pa.array(opens[cut]), pa.array(~last | ~going[end - 1]),
        ], ["conv_id", "conv", "chunk", "sub", "nth", "role_pred", "n_lines", "n_rows", "text", "opens", "closes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, run_lines
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < limit:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            whole = int(np.flatnonzero(heads(t))[-1])  # lines before the last chunk, which may go on
            if whole:
                yield decode(t.slice(0, whole).combine_chunks())
            held, size = t.slice(whole).to_batches(), len(t) - whole
            limit = max(run_lines, 2 * size)
        if held:
            yield decode(pa.Table.from_batches(held).combine_chunks())

    return run


def render(turns: DataFrame) -> DataFrame:
    """Adds rendered: the turn without its speaker marker, between the marks of its role; pieces inside a turn have no marks."""
    text = F.col("text")
    for role in ROLES:
        text = F.when(F.col("role_pred") == role, F.regexp_replace("text", MARKERS[role], "")).otherwise(text)
    opened = F.concat(F.lit("<|"), F.col("role_pred"), F.lit("|>\n"), text)
    body = F.when(F.col("opens"), opened).otherwise(F.concat(F.lit("\n"), F.col("text")))
    return turns.withColumn("rendered", F.concat(body, F.when(F.col("closes"), "<|end|>\n").otherwise("")))


#: Speaker names of the styles in which ``as_transcript`` writes a conversation.
STYLES = (("System", "User", "Assistant"), ("Instructions", "Human", "AI"), ("[system]", "Q", "A"), ("<|system|>", "<|user|>", "<|assistant|>"))


def as_transcript(turns: DataFrame, *, unmarked: int = 8) -> DataFrame:
    """The rows of (conv_id, turn, role, text) as parts of transcripts: text begins with a speaker's name, but for one turn in ``unmarked``.

    The style goes by conv_id, the unmarked turns by conv_id and turn. A role that isn't known, or null, is never marked.
    """
    pick = lambda n, *c: F.pmod(F.crc32(F.concat_ws(":", *c).cast("binary")), F.lit(n))
    name = F.lit(None).cast("string")
    for k, style in enumerate(STYLES):
        for role, said in zip(ROLES, style, strict=True):
            name = F.when((pick(len(STYLES), "conv_id") == k) & (F.lower("role") == role), said).otherwise(name)
    marked = name.isNotNull() & (pick(unmarked, "conv_id", "turn") != 0)
    return turns.withColumn("text", F.when(marked, F.concat(name, F.lit(": "), F.coalesce(F.col("text").cast("string"), F.lit("")))).otherwise(F.col("text").cast("string")))
