"""TEXT mode: lines -> kept sightings -> counts per feature (O-06, O-10, O-30)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grovecount.functions.text import ORANGE_SUFFIX, ends_with
from grovecount.operators.counts import as_sightings, keyed_sum


def text_sightings(lines: DataFrame, suffix: str = ORANGE_SUFFIX) -> DataFrame:
    """Filter + map of the TEXT job: ``(feature, n=1)`` for every kept line.

    Stateless, so it runs unchanged on a batch table or a stream.
    """
    return as_sightings(lines.where(ends_with("value", suffix)))


def text_counts(lines: DataFrame, suffix: str = ORANGE_SUFFIX) -> DataFrame:
    """Whole TEXT job on a bounded input: ``feature, n`` per kept line value."""
    return keyed_sum(text_sightings(lines, suffix))
