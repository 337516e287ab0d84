"""Writing: keyed merges as joins, validation, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens import config as C
from feedlens import schemas
from feedlens.session import forget, settle


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str, *, order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` to append: new keys, each once. The first write of a key wins.

    Of incoming rows that share a key the one of the lowest ``order`` stays, and of
    equal ones the lowest row by its columns in their order, so that a repeated run gives the same rows.
    """
    new = incoming.join(existing.select(key), key, "left_anti").select(*incoming.columns)
    rank = F.struct(*([order] if order else []), *[c for c, kind in new.dtypes if not kind.startswith("map")])
    return new.groupBy(key).agg(F.min_by(F.struct(*new.columns), rank).alias("_row")).select("_row.*")


def insert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(inserted, skipped) of ``insert_ignore``."""
    seen = existing.select(F.col(key), F.lit(True).alias("_seen")).dropDuplicates([key])
    per_key = incoming.groupBy(key).agg(F.count("*").alias("_n")).join(seen, key, "left")
    inserted = F.coalesce(F.sum(F.when(F.col("_seen").isNull(), 1).otherwise(0)), F.lit(0))
    return per_key.agg(inserted.alias("inserted"), (F.coalesce(F.sum("_n"), F.lit(0)) - inserted).alias("skipped"))


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The table after the merge: of each key the row of the highest version; an incoming row wins a tie.

    ``max_by`` keeps one row for each key and task, so a key with very many versions is combined before the shuffle.
    """
    columns = existing.columns
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.select(*columns).withColumn("_new", F.lit(1)))
    best = F.max_by(F.struct(*columns), F.struct(version, "_new"))
    return both.groupBy(key).agg(best.alias("_row")).select("_row.*")


def replace_keys(existing: DataFrame, recomputed: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Drop all rows of the touched keys and add the recomputed ones: stale rows can't stay behind."""
    return existing.join(touched.select(key).distinct(), key, "left_anti").unionByName(recomputed)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no parent row."""
    return child.join(parent.select(key), key, "left_anti")


def label_problem() -> Column:
    """Why a message label can't be stored, or null."""
    return F.coalesce(
        F.when(F.coalesce("feedback_id", F.lit("")) == "", "no id"),
        F.when(~F.coalesce(F.col("L1").isin(*C.L1_VALUES), F.lit(False)), "L1"),
        F.when(~F.coalesce(F.col("severity").isin(*C.SEVERITY_VALUES), F.lit(False)), "severity"),
        F.when(~F.coalesce(F.forall("L2", lambda x: x.isin(*C.L2_VALUES)), F.lit(True)), "L2"),
        F.when(~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False)), "confidence"),
    )


def split_valid(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to write, rows set aside with their problem): one bad row doesn't stop an import."""
    checked = rows.withColumn("problem", problem)
    return checked.where("problem is null").drop("problem"), checked.where("problem is not null")


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each table."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def mirror(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder for each table, replaced as a whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def import_tables(spark: SparkSession, tables: dict[str, tuple[DataFrame, str, Column]], path: str) -> DataFrame:
    """Write tables (rows, schema, problem) below ``path``, each on its own: (table, written, refused, error).

    Columns that the schema lacks are dropped, missing ones are null. A table's rows are computed once and told apart as written. Rows with a
    problem go to a folder of their own beside the table, with the problem. A table that
    fails leaves its error and the others are written.
    """
    out = []
    for name, (rows, schema, problem) in tables.items():
        try:
            checked = settle(schemas.conform(rows, schema).withColumn("problem", problem), "checked")
            checked.where("problem is null").drop("problem").write.mode("overwrite").parquet(f"{path}/{name}")
            checked.where("problem is not null").write.mode("overwrite").parquet(f"{path}/{name}_refused")
            forget(checked)
            out.append((name, *(spark.read.parquet(f"{path}/{name}{k}").count() for k in ("", "_refused")), None))
        except Exception as e:  # one table doesn't stop the others
            out.append((name, 0, 0, f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(out, "table string, written long, refused long, error string")


CSV_COLUMNS = ("conversation_id", "L1", "L2", "severity", "confidence", "reason", "msg_count", "first_ts_human", "last_ts_human", "user_vid", "appversion", "platform", "channel", "preview_text")


def csv_rows(items: DataFrame) -> DataFrame:
    """Listed conversations in the export's columns: times as text in the session's zone, nulls as empty text."""
    human = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss")
    rows = items.withColumns({"first_ts_human": human(F.col("first_ts_ms")), "last_ts_human": human(F.col("last_ts_ms"))})
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c in ("user_vid", "appversion", "platform") else F.col(c) for c in CSV_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, white space at the ends of texts kept; callers pass a page of bounded size."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def versions_text(entries: Column, *, pair: str = ":", sep: str = "|", close: str = "") -> Column:
    """'5.4.1:9|5.4.0:3' from array<struct<v, c>>: by falling count, then by version."""
    ordered = F.array_sort(entries, lambda a, b: F.when(a["c"] > b["c"], -1).when(a["c"] < b["c"], 1).when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(0))
    return F.array_join(F.transform(ordered, lambda e: F.concat(e["v"], F.lit(pair), e["c"].cast("string"), F.lit(close))), sep)


