"""T-5: rows dealt to tasks by their size instead of their number."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000  # rows of one prefix-sum window, on average


def deal_by_size(sizes: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """``*keys, part`` with part in 0..parts-1 for a stored table of distinct
    ``keys`` and their ``size`` (positive).

    With the mean share = total size / parts: a row of at least a share has a
    part to itself (there are at most ``parts`` such rows), and any other part
    holds less than two shares.  The others are cut by their prefix sum, taken
    in blocks of hashed keys plus the sums of the blocks before.
    """
    whole = sizes.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    share = (whole["size"] or 0) / parts
    is_large = F.col("size") >= F.lit(share)
    top = sizes.where(is_large).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), *keys)
    alone = sizes.where(is_large).select(*keys, (F.row_number().over(order) - 1).alias("part"))
    if top["n"] == whole["n"]:
        return alone

    blocks = 1 + whole["n"] // BLOCK_ROWS
    small = sizes.where(~is_large).withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)))
    # one row a block: BLOCK_ROWS times fewer than rows
    before = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = small.groupBy("block").agg(F.sum("size").alias("sum")).select(
        "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("start")
    )
    within = Window.partitionBy("block").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, "block")
    left = parts - top["n"]
    middle = F.col("start") + F.col("at") + F.col("size") / 2
    cut = F.floor(middle * left / F.lit(whole["size"] - (top["size"] or 0)))
    dealt = placed.select(*keys, (F.lit(top["n"]) + F.least(F.lit(left - 1), cut)).cast("int").alias("part"))
    return alone.unionByName(dealt)
