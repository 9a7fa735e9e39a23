"""Corpus preparation: quality rules, line deduplication, near-duplicate
removal, removal of repeated passages, packing.

Every stage takes all that the one before kept; ``STAGES`` lists them as
(name, function of (spark, docs, sf_dir)).  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecount.llm import lines, packing, quality, simhash, suffix
from grovecount.session import ensure_checkpoint_dir
from grovecount.sources.tables import read_table


def _recounted(docs: DataFrame) -> DataFrame:
    """Column n_chars, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality.passing(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur in ten documents or more stay in the first
    of them only; a document that held nothing else goes."""
    return _recounted(lines.without_recurring_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.without_near_duplicates(docs, shingle=3, max_bits=3)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document with a smaller id has too are
    cut out; a document that held nothing else goes."""
    return _recounted(suffix.without_repeats(docs, span=50))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048."""
    out = packing.pack_documents(docs, capacity=2048)
    return out.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        F.col("seq").alias("sequence_id"), "offset",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", passage_dedup),
    ("best_fit_packing", packed),
]

# token ids and the learned rules are beyond SQL; tests hold the stages against
# brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet to
    the shared checkpoint folder and read again."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{root}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
