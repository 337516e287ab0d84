"""Model calls whose answers are kept: a text is asked once, however often a task or a whole run starts again.

An answer is keyed by model, prompt and text. Each batch of calls is written below
the log's folder as soon as it is answered, in a file that its texts name, so a task that
starts again finds the batches of the attempt before it, and a later run asks
only what no file holds. The batches of a group of calls then become one file, from the
answers that the task still has: a log has a file for some thousand texts, however small batches are.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "call string, reply string"
FOLD = 4096  # calls of a group, whose batches become one file


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _stands(fs: pafs.FileSystem, file: str) -> bool:
    return fs.get_file_info(file).type != pafs.FileType.NotFound


def _read(fs: pafs.FileSystem, file: str) -> dict[str, str | None]:
    """The answers of a file, none if it isn't there or goes away."""
    try:
        if not _stands(fs, file):
            return {}
        with fs.open_input_file(file) as f:
            found = pq.read_table(f)
    except FileNotFoundError:
        return {}
    return dict(zip(*(found.column(c).to_pylist() for c in ("call", "reply")), strict=True))


def _write(fs: pafs.FileSystem, name: str, answers: dict[str, str | None]) -> None:
    """A file of answers, which is whole when its name stands."""
    temp = f"{name}.{time.time_ns()}.tmp"
    with fs.open_output_stream(temp) as f:
        pq.write_table(pa.table({"call": [*answers], "reply": pa.array([*answers.values()], pa.string())}), f)
    fs.move(temp, f"{name}.parquet")


def _of_groups(path: str):
    """A function for mapInArrow over names of groups: the answers of their batches.

    A group's own file is read after its batches, which go only when that file stands: what another run
    puts together meanwhile isn't missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        for batch in batches:
            for group in batch.column(0).to_pylist():
                files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/_{group}", allow_not_found=True)) if f.path.endswith(".parquet")]
                found = {c: r for f in (*files, f"{root}/{group}.parquet") for c, r in _read(fs, f).items()}
                yield pa.RecordBatch.from_pydict({"call": pa.array([*found], pa.string()), "reply": pa.array([*found.values()], pa.string())})

    return run


@dataclass(frozen=True)
class CallLog:
    """Answers below a folder that the driver and all executors share; ``path`` is a URI or a local path."""

    path: str
    model: str = "model"

    def call(self, prompt: str, text: Column) -> Column:
        """The key of a call."""
        return F.sha2(F.to_json(F.struct(F.lit(self.model), F.lit(prompt), text)), 256)

    def answers(self, spark: SparkSession) -> DataFrame:
        """(call, reply) of all answered calls, each once."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return spark.createDataFrame([], ANSWER)
        # groups that a task has begun, or was lost in; listed first, so that one that is put together now is found here or there
        begun = [(name[1:],) for name in (s.getPath().getName() for s in fs.listStatus(path)) if name.startswith("_")]
        out = spark.read.schema(ANSWER).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(self.path)  # leaves out folders with _
        if begun:
            out = out.unionByName(spark.createDataFrame(begun, "name string").mapInArrow(_of_groups(self.path), ANSWER))
        return out.dropDuplicates(["call"])

    def compact(self, spark: SparkSession) -> None:
        """One set of files in place of one file for each group; run it while no call is made. The old ones go after the new ones stand."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return
        old = [s.getPath() for s in fs.listStatus(path)]
        self.answers(spark).write.parquet(f"{self.path}/whole-{time.time_ns()}")
        for p in old:
            fs.delete(p, True)


def _ask(log: CallLog, ask: Callable[[list[str]], Sequence[str | None]], size: int, end: float | None):
    """A function for mapInArrow over (call, text) in the order of calls: (state, n) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(log.path)
        fs.create_dir(root, recursive=True)
        most = max(1, FOLD // size) * size
        waiting: list[tuple[str, str]] = []
        named = lambda part: hashlib.sha256("".join(c for c, _ in part).encode()).hexdigest()

        def group(calls: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
            name = named(calls)
            folder, whole = f"{root}/_{name}", f"{root}/{name}"
            held = _read(fs, f"{whole}.parquet")

            def turn(part: list[tuple[str, str]]) -> str:
                batch = f"{folder}/{named(part)}"
                for file in (batch, whole):
                    if all(c in held for c, _ in part):
                        return "known"
                    held.update(_read(fs, f"{file}.parquet"))
                if all(c in held for c, _ in part):
                    return "known"
                if end is not None and time.time() >= end:
                    return "late"
                try:
                    found = [*ask([t for _, t in part]), *[None] * len(part)][: len(part)]
                    answers = {c: r for (c, _), r in zip(part, found, strict=True)}
                    fs.create_dir(folder, recursive=True)
                    _write(fs, batch, answers)
                except Exception:  # a call that fails is open for the next run
                    return "failed"
                held.update(answers)
                return "answered"

            for lo in range(0, len(calls), size):
                part = calls[lo : lo + size]
                yield pa.RecordBatch.from_pydict({"state": [turn(part)], "n": [len(part)]})
            try:
                if held and not _stands(fs, f"{whole}.parquet"):
                    _write(fs, whole, held)
                    fs.delete_dir(folder)
            except OSError:  # the batches' files are read as well
                pass

        for batch in batches:
            waiting += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            while len(waiting) >= most:
                yield from group(waiting[:most])
                waiting = waiting[most:]
        if waiting:
            yield from group(waiting)

    return run


def ask_once(rows: DataFrame, log: CallLog, prompt: str, ask: Callable[[list[str]], Sequence[str | None]], *, size: int = 16, partitions: int = 8, seconds: float | None = None) -> DataFrame:
    """``rows`` with a text, and the model's ``reply`` to each: from the log, or asked now.

    Runs the open calls at once. Equal texts are one call. ``ask`` gets up to
    ``size`` texts; answers are matched by place, a missing one is null and is kept. At most
    ``partitions`` calls run at a time. No call begins later than ``seconds`` after
    the start, also inside a task's share. Calls that fail or come too late have a null
    reply and ``answered`` false, and are asked again by the next run. A null text counts as empty.
    """
    spark = rows.sparkSession
    end = None if seconds is None else time.time() + seconds
    keyed = rows.withColumn("_call", log.call(prompt, F.coalesce("text", F.lit(""))))
    known = log.answers(spark).select("call")
    wanted = keyed.select(F.col("_call").alias("call"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["call"])
    open_ = wanted.join(known, "call", "left_anti").repartition(partitions, "call").sortWithinPartitions("call")
    open_.mapInArrow(_ask(log, ask, size, end), "state string, n long").groupBy("state").agg(F.sum("n")).collect()
    told = log.answers(spark).withColumnRenamed("call", "_call").withColumn("answered", F.lit(True))
    return keyed.join(told, "_call", "left").withColumn("answered", F.coalesce("answered", F.lit(False))).drop("_call")


def score_once(texts: DataFrame, log: CallLog, query: str, ask: Callable[[str, list[tuple[str, str]]], list[dict]], *, size: int = 5, partitions: int = 8, seconds: float | None = None) -> DataFrame:
    """(conversation_id, score, reason) of (conversation_id, text) as by ``score_conversations``, each text asked once for a query.

    Instead of an id a call gets its place. What fails or comes too late counts 2 and 'timeout'.
    """

    def told(part: list[str]) -> list[str | None]:
        return [json.dumps({"score": r.get("score"), "reason": r.get("reason")}, ensure_ascii=False) for r in ask(query, [(str(k), t) for k, t in enumerate(part)])]

    found = ask_once(texts.select("conversation_id", "text"), log, query, told, size=size, partitions=partitions, seconds=seconds)
    reply = F.from_json("reply", "score string, reason string")
    score = F.when(reply["score"].isin("1", "2", "3"), reply["score"].cast("int")).otherwise(2)
    reason = F.when(~F.col("answered"), "timeout").when(F.col("reply").isNull(), "missing").otherwise(F.coalesce(reply["reason"], F.lit("")))
    return found.select("conversation_id", score.alias("score"), reason.alias("reason"))
