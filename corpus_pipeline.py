"""The corpus pipeline: quality rules, exact dedup, near dedup, secret redaction, packing.

Each stage takes the documents that its predecessor kept, all of them, as (spark, docs, sf_dir), and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. The last returns the packing: one row
for each piece of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkward.llm.common import drop_paths, read_table, tables_made, written
from sparkward.llm.exact_dedup import keep_one_of_equal
from sparkward.llm.ngram_join import keep_one_of_similar
from sparkward.llm.packing import pack_documents
from sparkward.llm.quality_rules import keep_good
from sparkward.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie beyond their group's fences go."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return keep_one_of_equal(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one with the least doc_id stays."""
    return keep_one_of_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mask; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("secret_scan", secrets), ("packing", packing)]

#: Chosen paths and best fit can't be written in SQL; tests hold the stages against a pipeline by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage made on its way, and its input, are deleted once its result is written."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with tables_made() as made:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_paths(spark, [*made, *before], docs)
        before = made
    return docs
