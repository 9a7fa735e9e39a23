"""Dense tile voting: the same cells as the row form, tiles of any size, and
what is shuffled is edge pixels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovecount.operators.hough import candidates, vote_counts
from grovecount.operators.hough_tiles import smallest_count, tile_candidates, tile_votes

EDGES = "image_id string, x int, y int"
DIMS = "image_id string, width int, height int"


def rows(df):
    return sorted(tuple(r) for r in df.select("image_id", "a", "b", "r", "votes").collect())


@pytest.fixture(scope="module")
def drawn(spark):
    """Rings on images of three sizes (one too small for a radius, one without
    edges), centres near and beyond the borders, one edge row repeated."""
    rng = np.random.default_rng(7)
    edges, dims = set(), [("wide", 150, 60), ("tall", 40, 110), ("dot", 9, 9), ("bare", 60, 60)]
    for name, w, h in dims[:2]:
        for _ in range(4):
            cx, cy, r = rng.integers(-3, w + 3), rng.integers(-3, h + 3), rng.integers(min(w, h) // 15 + 1, max(w, h) // 10 + 1)
            t = 2 * np.pi * np.arange(200) / 200
            x, y = np.trunc(cx + r * np.cos(t)).astype(int), np.trunc(cy + r * np.sin(t)).astype(int)
            ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
            edges |= {(name, int(a), int(b)) for a, b in zip(x[ok], y[ok])}
    edges = sorted(edges) + [("dot", 3, 3), ("wide", 20, 20), ("wide", 20, 20)]
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame(dims, DIMS)


@pytest.mark.parametrize("tile, cells, pairs", [(256, 1 << 22, 1 << 21), (32, 5000, 1000), (7, 1, 1)])
def test_equals_the_row_form(drawn, tile, cells, pairs):
    edges, dims = drawn
    want = rows(vote_counts(edges, dims))
    assert rows(tile_votes(edges, dims, tile=tile, cells=cells, pairs=pairs)) == want
    assert {r[0] for r in want} == {"wide", "tall"}


@pytest.mark.parametrize("steps, threshold", [(100, 0.4), (100, 0.0), (36, 0.7), (7, 0.3), (100, 1.5)])
def test_threshold_in_the_task(drawn, steps, threshold):
    edges, dims = drawn
    want = rows(candidates(vote_counts(edges, dims, steps), steps, threshold))
    assert rows(tile_candidates(edges, dims, steps, threshold)) == want
    assert bool(want) == (threshold < 1)


def test_smallest_count():
    for steps in (1, 7, 36, 100):
        for threshold in (0.0, 0.1, 0.3, 0.4, 0.7, 1.0):
            assert smallest_count(steps, threshold) == min(v for v in range(1, steps + 1) if v / steps >= threshold)
    assert smallest_count(100, 1.01) == 101


def test_empty_and_null_ids(spark, drawn):
    _, dims = drawn
    assert rows(tile_votes(spark.createDataFrame([], EDGES), dims)) == []
    carried = spark.createDataFrame(
        [(None, 5, 5, 2, 3), ("a", 5, 5, 2, 3), ("a", 6, 6, 4, 3)], EDGES + ", r_min int, r_max int"
    )
    out = tile_votes(carried, dims).groupBy("image_id").agg(F.sum("votes").alias("v")).collect()
    assert {r.image_id: r.v for r in out} == {None: 200, "a": 200}  # 100 steps for each of two radii


@pytest.mark.parametrize("tile, steps, broadcast", [(1024, 100, 1 << 25), (9, 100, 1 << 25), (16, 12, 0)])
def test_row_form_by_tile(drawn, monkeypatch, tile, steps, broadcast):
    import grovecount.operators.hough as hough

    edges, dims = drawn
    want = rows(vote_counts(edges, dims, steps))
    monkeypatch.setattr(hough, "ROW_TILE", tile)
    monkeypatch.setattr(hough, "VOTES_PER_TASK", 20_000)
    monkeypatch.setattr(hough, "MAX_BROADCAST_BYTES", broadcast)
    assert rows(vote_counts(edges, dims, steps, by_tile=True)) == want and want


def test_hough_votes_shuffles_edges_not_votes(spark):
    import __spark_entry__ as entry

    df = entry.queries()["hough_votes"](spark, "/root/testdata/sf0.001")
    assert _shuffled(df) < df.count() / 10


def test_large_radii_cross_many_tiles(spark):
    """Radii beyond 200 pixels, wider than a tile: an edge reaches more than four tiles."""
    edges = spark.createDataFrame([("big", 700, 300), ("big", 1400, 900)], EDGES)
    dims = spark.createDataFrame([("big", 3000, 2500)], DIMS)
    assert rows(tile_votes(edges, dims, steps=12)) == rows(vote_counts(edges, dims, steps=12))


def _shuffled(df):
    """Rows that the exchanges of ``df`` write, from the plan's own counters."""
    df.write.format("noop").mode("overwrite").save()
    qe = df._jdf.queryExecution()
    qe.executedPlan().execute().count()
    todo, total = [qe.executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_fewer_rows_are_shuffled_than_votes(spark):
    """A 300x200 image (18 radii): the row form shuffles its vote cells, the tile
    form a few copies of its edge pixels."""
    t = 2 * np.pi * np.arange(300) / 300
    ring = {
        (int(cx + r * np.cos(u)), int(cy + r * np.sin(u)))
        for cx, cy, r in ((60, 60, 20), (150, 100, 26), (240, 130, 15)) for u in t
    }
    edges = spark.createDataFrame([("i", x, y, 13, 30) for x, y in sorted(ring)], EDGES + ", r_min int, r_max int")
    dims = spark.createDataFrame([("i", 300, 200)], DIMS)
    cells = vote_counts(edges, dims)
    before, after = _shuffled(cells), _shuffled(tile_candidates(edges, dims))
    assert after <= 4 * len(ring) < before / 20, (len(ring), before, after)
