"""A corpus pipeline over documents: language ID, line dedup, near-dedup, secret scans, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, also further ones.

A null text has no language, so the first stage drops its document; an empty one goes the same way. Repeated rows stay as they
are until near-dedup, where rows with one doc_id are one document and stay or go together. Rows without doc_id count as one
document for each different text. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltql.llm import language_id, line_dedup, near_dedup, packing, secret_scan
from basaltql.llm.spark_tools import read, written


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, after a change of text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an ambiguous one, go."""
    return language_id.accepted(docs, language_id.fit(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; every document stays, even with no line left."""
    return _measured(line_dedup.drop_repeated_lines(docs, line_dedup.EVERY_LINE))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    kept = near_dedup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept"]), "left_semi")


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return _measured(secret_scan.redact(docs, secret_scan.fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces: as op4's, with the ids of each."""
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: Edit distances, sketches, trained models and tokenizers have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
