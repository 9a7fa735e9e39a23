"""O-22 / O-12: every left row keeps its place; a missing match counts as 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup_count(
    left: DataFrame,
    counts: DataFrame,
    key: str,
    value: str = "n",
    default: int = 0,
) -> DataFrame:
    """Left join ``counts`` on ``key`` and replace a missing ``value`` by ``default``.

    ``counts`` must already be one row per key (pre-aggregate it: that also
    makes its shuffle partitioning on ``key`` serve the join, so each side is
    shuffled once and neither side is broadcast without a size bound).
    """
    return left.join(counts, on=key, how="left").withColumn(
        value, F.coalesce(F.col(value), F.lit(default)).cast("bigint")
    )
