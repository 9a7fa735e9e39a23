"""Exact deduplication by a tree merge of sorted digest runs.

Every scan partition sorts its rows by digest and reduces them to a run of
(digest, identifier to keep, count).  Runs are then merged in rounds: in each
round ``fan_in`` neighbouring runs are brought into one order and walked digest
by digest, retaining the smallest (or largest) identifier and the summed
counts, until one run is left.  Both steps are aggregations over sorted rows:
neighbours in the order are combined and no hash table is held.  A run is never one task's data: within a round the rows of all runs
are dealt over all tasks by (target run, digest), so the last round is as
parallel as the first.  A text that makes up a third of the table is one row
per partition from the first level on.

Digests are verified: SHA-256 together with the byte length and an
independent XXH64 of the text make up the key, so two texts share a group only
if all three agree.

Edge cases: null text counts as empty; null identifiers never win unless the
whole group has none; repeated rows (same identifier, same text) all count
and are all flagged as kept when their identifier is the one kept; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.llm.common import keyed_text

KEY = ["digest", "bytes", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, digest, bytes, check, run`` per row; ``run`` is the scan partition."""
    return keyed_text(docs, id_col, text_col).select(
        "id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64("text").alias("check"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(runs: DataFrame, keep: str, shift: int) -> DataFrame:
    """One level of the tree: ``2 ** shift`` neighbouring runs become one, each
    a sorted sequence of distinct digests again.

    The identifier travels as (rank, identifier), so that nulls lose; Spark
    aggregates such a pair over sorted input only, which makes the level a merge."""
    best = {"min": F.min, "max": F.max}[keep]
    known = F.col("keep_id").isNull() if keep == "min" else F.col("keep_id").isNotNull()
    return (
        runs.withColumn("run", F.shiftright("run", shift))
        .groupBy("run", *KEY)
        .agg(best(F.struct(known.alias("rank"), "keep_id")).alias("best"), F.sum("n").alias("n"))
        .select("run", *KEY, F.col("best.keep_id").alias("keep_id"), "n")
    )


def exact_groups(
    docs: DataFrame, keep: str = "min", fan_in_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, keep_id, group_size, kept, digest`` per row of ``docs``."""
    # written once: the run numbers must not change between the two uses
    rows = digests(docs, id_col, text_col).checkpoint()
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = rows.select("run", *KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    runs = merge_runs(runs, keep, 0)
    while last:
        runs = merge_runs(runs, keep, fan_in_bits)
        last >>= fan_in_bits
    groups = runs.select(*KEY, "keep_id", F.col("n").alias("group_size"))
    out = rows.join(groups.hint("merge"), KEY)
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op6(spark, sf_dir):
    from grovecount.sources.tables import read_table

    out = exact_groups(read_table(spark, sf_dir, "documents"), keep="max")
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
