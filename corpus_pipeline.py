"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing.

``run`` applies the stages to the documents of a folder; each stage reads all
rows that the one before kept, as written Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlens.llm import minhash, packing, quality, toxicity
from feedlens.llm.common import fresh_dir, settle, table
from feedlens.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject. All columns stay; a document without text stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that fail; n_chars follows the text."""
    return quality.clean_documents(docs)


def _own_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, in any case of letters."""
    taken, mark = {c.lower() for c in docs.columns}, ""
    while any(f"{n}{mark}" in taken for n in names):
        mark += "_"
    return [f"{n}{mark}" for n in names]


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row: of the values, and of which are null; what has no hash, as maps, is taken as JSON."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(F.struct(c.alias("v"))) if "map<" in kind or "variant" in kind else c for c, (_, kind) in zip(columns, docs.dtypes, strict=True)]
    return F.xxhash64(*plain, *[c.isNull() for c in columns])  # hashes skip nulls


def _named(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a column ``name``, a number of its own for every different row; of equal rows one.

    It is the doc_id, or a hash of the whole row, of 2 ** 62 or more, where that
    is null or a smaller row hash has the same doc_id. Only rows whose name isn't
    theirs alone are moved for this; usually there are none.
    """
    row, first, n = _own_names(docs, "row_hash", "first_hash", "n_rows")
    own = F.shiftrightunsigned(row, 2).bitwiseOR(F.lit(1 << 62))
    rows = docs.withColumn(row, _row_hash(docs)).withColumn(name, F.coalesce(F.col("doc_id").cast("long"), own))
    shared = rows.groupBy(name).agg(F.min(row).alias(first), F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    shared = settle(shared, "shared")
    columns = [F.col(f"`{c}`") for c in (*docs.columns, name)]
    if shared.isEmpty():
        return rows.select(*columns)
    many = rows.join(shared, name).withColumn(name, F.when(F.col(row) > F.col(first), own).otherwise(F.col(name)))
    many = many.select(*columns).dropDuplicates([name])
    return rows.join(shared, name, "left_anti").select(*columns).union(many)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id.

    Every different row is a document: one with a null doc_id, or another row of
    a doc_id, is compared like the rest and stands behind all other ids. Of equal
    rows one stays. Columns of any name and type come back as they are.
    """
    (name,) = _own_names(docs, "row_name")
    rows = _named(docs, name)
    found = minhash.near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"))
    gone = settle(found.where("not kept").select(F.col("doc_id").alias(name)), "gone")
    return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 4096 ids."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", clean_quality), ("minhash", drop_near_copies), ("packing", pack)]

#: The toxicity model and the signatures aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = fresh_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
