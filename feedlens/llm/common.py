"""Helpers that the operators share: reading, shared folders, batch functions."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, one is made, and removed at exit, if the
    session runs on this machine alone; on a cluster, whose executors wouldn't
    see it, this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="feedlens-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if root.startswith("file:/") and not root.startswith("file://"):
        root = f"file://{root[5:]}"
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder and read it again: later steps don't repeat its work,
    and a lost executor costs no recomputation."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete the folders of settled frames that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        own = shared_dir(spark).split(":", 1)[1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send documents to Python workers in batches of at most ``rows``: they may be long, and a batch stands in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def release_memory() -> None:
    """Give what a task has freed back to the system: worker processes live on, and the next stage shares their machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow in small batches; unused memory goes back when a task ends."""
    small_batches(df.sparkSession)

    def whole(batches):
        yield from run(batches)
        release_memory()

    return df.mapInArrow(whole, schema)


def each_batch(make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A function for mapInArrow from one for a batch; ``make`` runs once in each task."""

    def run(batches):
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    return run


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema) -> DataFrame:
    return arrow_map(df, each_batch(make), schema)


def map_rows(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``map_batches`` for a function that gives rows of the same columns; their names, which may be any, are put aside meanwhile."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return map_batches(plain, make, plain.schema).toDF(*docs.columns)


def held_out(key: str, modulus: int, remainder: int):
    """True for the rows that training leaves out: crc32 of the id as text."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session, where a repartition needs a number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
