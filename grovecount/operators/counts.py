"""Keyed counts and sums (O-10, O-30, O-31) and the static tumbling window (T-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_sightings(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """O-10: the whole line is the feature, each line counts once; other columns
    (a batch's time stamp) stay."""
    rest = [c for c in lines.columns if c != value_col]
    return lines.select(F.col(value_col).alias("feature"), F.lit(1).alias("n"), *rest)


def keyed_sum(
    sightings: DataFrame, key: str = "feature", value: str = "n", extra_keys: tuple[str, ...] = ()
) -> DataFrame:
    """O-30: sum of ``value`` per key.

    Catalyst plans a partial hash aggregate before the shuffle, so only one
    row per (task, key) crosses the network: a hot key costs one row per task,
    never a third of the input in one reducer.
    """
    return sightings.groupBy(*extra_keys, key).agg(F.sum(value).cast("bigint").alias("n"))


def tumbling_sum(
    df: DataFrame,
    time_col: str,
    key_col: str,
    value: str | None = None,
    duration: str = "10 seconds",
) -> DataFrame:
    """T-1 (static form): sum per ``key`` per tumbling window of ``time_col``.

    Output ``window_start, window_end, feature, n``.  ``value=None`` counts rows.
    """
    agg = F.count(F.lit(1)) if value is None else F.sum(value)
    return (
        df.groupBy(F.window(time_col, duration).alias("w"), F.col(key_col).alias("feature"))
        .agg(agg.cast("bigint").alias("n"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "feature",
            "n",
        )
    )


def totals_from_ledger(ledger: DataFrame) -> DataFrame:
    """O-31: running totals are the sum over every committed ledger row.

    Additive and order-free, so replays that overwrite their own ``batch_id``
    never double count.
    """
    return ledger.groupBy("feature").agg(F.sum("n").cast("bigint").alias("n"))
