"""Connected components of an undirected graph given as an edge table.

Alternating large-star / small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014): O(log^2 n) rounds in the
worst case and a handful in practice, each a few grouped aggregates and joins
over the edge list.  No node's neighbourhood is ever collected: hub nodes
are handled by min-aggregates, so a giant component is spread like any
other key.  Rounds are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.plans.lineage import RoundTables


def _oriented(edges: DataFrame) -> DataFrame:
    """``src > dst`` form, no self loops, no duplicates."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _large_star(e: DataFrame) -> DataFrame:
    # both directions: every node sees all its neighbours
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.min("dst").alias("m"))
    low = low.select("src", F.least("src", "m").alias("m"))
    # every strictly larger neighbour v of u is linked to the smallest of u's neighbourhood
    return (
        both.where(F.col("dst") > F.col("src"))
        .join(low, "src")
        .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    # e is src > dst: dst are the smaller neighbours of src
    low = e.groupBy("src").agg(F.min("dst").alias("m"))
    moved = e.join(low, "src").where(F.col("dst") != F.col("m")).select(
        F.col("dst").alias("src"), F.col("m").alias("dst")
    )
    return moved.unionByName(low.select("src", F.col("m").alias("dst"))).distinct()


def _is_star(e: DataFrame) -> bool:
    """Every edge points at a root and every non-root has one parent."""
    parents = e.select(F.col("src").alias("dst")).distinct()
    chained = e.join(parents, "dst", "left_semi").select(F.lit(1).alias("bad"))
    shared = e.groupBy("src").count().where(F.col("count") > 1).select(F.lit(1).alias("bad"))
    return chained.unionByName(shared).isEmpty()  # one job for both conditions


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``node, label`` for every node that has an edge; ``label`` is the
    smallest node of its component.  ``edges`` has long columns ``src, dst``."""
    rounds = RoundTables(edges.sparkSession, "components")
    e = rounds.write(_oriented(edges), "edges")
    for _ in range(max_rounds):
        if _is_star(e):
            roots = e.select(F.col("dst").alias("node"), F.col("dst").alias("label")).distinct()
            return e.select(F.col("src").alias("node"), F.col("dst").alias("label")).unionByName(roots)
        e = rounds.write(_large_star(e), "large")
        e = rounds.write(_small_star(e), "small")
    raise RuntimeError("connected components did not converge")
