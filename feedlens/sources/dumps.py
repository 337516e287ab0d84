"""Raw responses of pulled windows as a source, and a keyed table elsewhere as a sink.

A pull lands its responses in a folder of its own, one folder inside it for each
window of time, one response a line. The source reads one window in a task, as a
batch or as a stream of pulls; a line that is no response, or one that reports an
error, is a row with its problem. The sink writes by batches; a batch that
fails is written row by row, so that one bad row is set aside alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

from feedlens import schemas

LANDED = "pull string, start_sec long, end_sec long, body string, problem string"


def dump(responses: DataFrame, path: str, pull: str) -> None:
    """Land (start_sec, end_sec, body) below ``path`` as a pull, by windows. A pull's name sorts after those before it; one that is there is refused, never written over."""
    window = F.concat_ws("-", "start_sec", "end_sec")
    rows = responses.select(F.regexp_replace("body", r"[\r\n]+", " ").alias("value"), window.alias("window"))
    rows.write.partitionBy("window").text(f"{path}/{pull}")


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def problem_of(line: str) -> str | None:
    """Why a landed line is no usable response."""
    try:
        told = json.loads(line)
    except ValueError:
        return "no JSON"
    if not isinstance(told, dict):
        return "no object"
    if told.get("errCode") not in (0, None):
        return f"errCode {told['errCode']}"
    return None if isinstance(told.get("results"), list) else "no results"


@dataclass
class Window(InputPartition):
    pull: str
    name: str

    def __post_init__(self):
        super().__init__(f"{self.pull}/{self.name}")


class _Landed:
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def pulls(self) -> list[str]:
        """Whole pulls in order: one without its mark of success is still written, or broken off."""
        fs, root = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory)
        return [n for n in names if fs.get_file_info(f"{root}/{n}/_SUCCESS").type == pafs.FileType.File]

    def windows(self, pulls: list[str]) -> list[Window]:
        fs, root = _fs(self.path)
        return [Window(p, f.base_name) for p in pulls for f in fs.get_file_info(pafs.FileSelector(f"{root}/{p}")) if f.base_name.startswith("window=")]

    def lines(self, part: Window) -> Iterator[tuple]:
        fs, root = _fs(self.path)
        start, end = map(int, part.name.removeprefix("window=").split("-"))
        for f in sorted(fs.get_file_info(pafs.FileSelector(f"{root}/{part.pull}/{part.name}")), key=lambda f: f.path):
            if not f.base_name.endswith(".txt"):
                continue
            with fs.open_input_stream(f.path) as src:
                held = b""
                while piece := src.read(1 << 20):
                    *whole, held = (held + piece).split(b"\n")
                    for line in whole:
                        yield self._row(part.pull, start, end, line)
                if held:
                    yield self._row(part.pull, start, end, held)

    @staticmethod
    def _row(pull: str, start: int, end: int, line: bytes) -> tuple:
        text = line.decode("utf-8", "replace")
        why = problem_of(text)
        return pull, start, end, text, why


class LandedReader(_Landed, DataSourceReader):
    def partitions(self) -> list[Window]:
        return self.windows(self.pulls())

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.lines(partition)


class LandedStream(_Landed, DataSourceStreamReader):
    """Offsets are the names of pulls: all up to one are taken in together."""

    def initialOffset(self) -> dict:
        return {"pull": ""}

    def latestOffset(self) -> dict:
        return {"pull": max(self.pulls(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return self.windows([p for p in self.pulls() if start["pull"] < p <= end["pull"]])

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.lines(partition)

    def commit(self, end: dict) -> None:
        pass


class LandedSource(DataSource):
    """``spark.dataSource.register(LandedSource)``, then ``format("landed").load(path)``, also as a stream: rows of LANDED."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema) -> DataSourceReader:
        return LandedReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LandedStream(self.options["path"])


def split_landed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses of the message service, landed rows with a problem); rows are those of LANDED."""
    good = rows.where("problem is null").select("pull", "start_sec", "end_sec", F.from_json("body", schemas.RAW_RESPONSE).alias("r"))
    return good.select("pull", "start_sec", "end_sec", "r.*"), rows.where("problem is not null")


@dataclass
class Written(WriterCommitMessage):
    upserted: int
    refused: str | None
    errors: int


class UpsertWriter(DataSourceWriter):
    """Calls ``sink.upsert`` with batches of rows, each a dict; what a single row fails with goes to a file of its task."""

    def __init__(self, sink: UpsertSink, columns: list[str]):
        self.sink, self.columns = sink, columns
        self.refused, self.size = sink.options["refused"], int(sink.options.get("batchrows", "500"))

    def write(self, iterator: Iterator[Row]) -> Written:
        done, bad, held = 0, [], []

        def flush() -> None:
            nonlocal done
            try:
                self.sink.upsert(held)
                done += len(held)
            except Exception:  # which row is at fault shows when each is written alone
                for row in held:
                    try:
                        self.sink.upsert([row])
                        done += 1
                    except Exception as e:
                        bad.append({"row": row, "error": f"{type(e).__name__}: {e}"[:500]})

        for r in iterator:
            held.append({c: r[c] for c in self.columns})
            if len(held) >= self.size:
                flush()
                held = []
        if held:
            flush()
        path = None
        if bad:
            fs, root = _fs(self.refused)
            fs.create_dir(root, recursive=True)
            path = f"{root}/{uuid.uuid4().hex}.json"
            with fs.open_output_stream(path) as f:
                f.write("".join(json.dumps(b, ensure_ascii=False, default=str) + "\n" for b in bad).encode())
        return Written(done, path, len(bad))

    def commit(self, messages: list[Written | None]) -> None:
        """Counts of the whole write beside the refused rows."""
        fs, root = _fs(self.refused)
        fs.create_dir(root, recursive=True)
        told = {"upserted": sum(m.upserted for m in messages if m), "errors": sum(m.errors for m in messages if m)}
        with fs.open_output_stream(f"{root}/summary.json") as f:
            f.write(json.dumps(told).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """The refused rows of tasks that ended; rows that were written stay, and are written again, by key, with the next try."""
        fs, _ = _fs(self.refused)
        for m in messages:
            if m and m.refused:
                fs.delete_file(m.refused)


class UpsertSink(DataSource):
    """A sink for a keyed table: a subclass gives ``upsert`` and, if it likes, ``name``; options are ``refused``, a folder, and ``batchRows``.

    ``upsert(rows)`` inserts or replaces dicts by key, all or, if it raises, none. Columns are projected
    before: ``schemas.conform`` drops those that the table doesn't have.
    """

    @classmethod
    def name(cls) -> str:
        return "upsert"

    def upsert(self, rows: list[dict]) -> None:
        raise NotImplementedError

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return UpsertWriter(self, schema.fieldNames())
