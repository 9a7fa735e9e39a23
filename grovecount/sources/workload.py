"""O-05: the synthetic sighting workload, derived row-for-row from a table.

The original draws each line uniformly from five phrases with a shell random
number.  Here the phrase is a deterministic hash of a row id, so the workload
grows with whatever table drives it and any engine can recompute it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The five phrases of the original workload, in its order.
# Three of them end in "orange" (expected selectivity 60 %).
WORKLOAD_PHRASES = ("ripe orange", "immature orange", "leaf", "branch", "rotten orange")

# Multiplier of the row-id hash; a prime so consecutive ids spread over phrases.
HASH_MULTIPLIER = 7919


def workload_lines(
    df: DataFrame, id_col: str, phrases: tuple[str, ...] = WORKLOAD_PHRASES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One ``value`` line per input row: ``phrases[(id * 7919) mod len]``."""
    pick = F.pmod(F.col(id_col) * F.lit(HASH_MULTIPLIER), F.lit(len(phrases))).cast("int") + 1
    return df.select(*keep, F.element_at(F.array(*[F.lit(p) for p in phrases]), pick).alias("value"))
