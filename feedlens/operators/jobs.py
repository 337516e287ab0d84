"""The life of a report job, as rows of a small table of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a job may turn into; only failed jobs can be tried again.
MOVES = {"pending": ("running",), "running": ("succeeded", "failed"), "failed": ("pending",), "succeeded": ()}
ERROR_CHARS = 500


def may_move(status: Column, to: Column) -> Column:
    return F.concat_ws(">", status, to).isin(*[f"{a}>{b}" for a, after in MOVES.items() for b in after])


def apply_moves(jobs: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs after the moves, moves that weren't allowed).

    ``jobs`` (job_id, status, error_message, sample_count, started_at, finished_at),
    ``moves`` (job_id, to, at, error_message, sample_count), one a job. A retry
    clears what the failed try left.
    """
    m = moves.select("job_id", "to", "at", F.col("error_message").alias("_error"), F.col("sample_count").alias("_samples"))
    both = jobs.join(m, "job_id", "left").withColumn("_ok", F.col("to").isNotNull() & F.coalesce(may_move(F.col("status"), F.col("to")), F.lit(False)))
    ok, to = F.col("_ok"), F.col("to")
    done = to.isin("succeeded", "failed")
    out = both.select(
        "job_id", F.when(ok, to).otherwise(F.col("status")).alias("status"), F.when(~ok, F.col("error_message")).when(to == "failed", F.substring("_error", 1, ERROR_CHARS)).alias("error_message"),
        F.when(~ok, F.col("sample_count")).when(to == "succeeded", F.col("_samples")).when(to == "pending", F.lit(0)).otherwise(F.col("sample_count")).alias("sample_count"),
        F.when(~ok, F.col("started_at")).when(to == "running", F.col("at")).when(done, F.col("started_at")).alias("started_at"), F.when(~ok, F.col("finished_at")).when(done, F.col("at")).alias("finished_at"),
    )
    refused = both.where(F.col("to").isNotNull() & ~ok).select("job_id", "status", "to")
    return out, refused
