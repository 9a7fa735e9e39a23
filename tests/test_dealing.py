"""T-5: images dealt to tasks by their size."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grovecount.operators import dealing
from grovecount.operators.dealing import deal_by_size

SIZES = "name string, size long"


def loads(out, sizes):
    of = dict(sizes)
    load, names = Counter(), {}
    for r in out.collect():
        load[r.part] += of[r.name]
        names.setdefault(r.part, []).append(r.name)
    assert sorted(n for ns in names.values() for n in ns) == sorted(of)  # each row once
    return load, names


@pytest.mark.parametrize("n, parts, kind", [
    (500, 8, "even"), (500, 8, "heavy"), (500, 7, "one huge"), (5, 8, "heavy"), (8, 8, "even"), (1, 4, "even"),
    (300, 1, "heavy"),
])
def test_no_part_holds_two_shares(spark, monkeypatch, n, parts, kind):
    monkeypatch.setattr(dealing, "BLOCK_ROWS", 40)
    r = random.Random(n + parts)
    draw = {"even": lambda: 100, "heavy": lambda: int(r.paretovariate(1.1) * 10), "one huge": lambda: r.randint(1, 9)}[kind]
    sizes = [(f"i{k}", draw()) for k in range(n)]
    if kind == "one huge":
        sizes.append(("huge", 10_000))
    load, names = loads(deal_by_size(spark.createDataFrame(sizes, SIZES), ["name"], parts), sizes)
    share = sum(s for _, s in sizes) / parts
    assert all(0 <= p < parts for p in load)
    for p, total in load.items():
        assert total < 2 * share or len(names[p]) == 1, (p, total, share)


def test_empty(spark):
    assert deal_by_size(spark.createDataFrame([], SIZES), ["name"], 4).count() == 0


def test_images_reach_the_tasks_they_are_dealt_to(spark):
    from grovecount.plans.image_job import image_counts

    def image(name, side):
        return name, side, side, 3, bytes(3 * side * side)

    rows = [image(f"a_{k}.png", 20 + k % 5) for k in range(60)] + [image("b_big.png", 200)]
    images = spark.createDataFrame(rows, "image_name string, height int, width int, n_channels int, data binary")
    result = image_counts(images.select("image_name"), images, parallelism=6)
    per_task = result.found.groupBy(F.spark_partition_id().alias("task")).agg(
        F.sum(F.length("data")).alias("size"), F.count(F.lit(1)).alias("n")
    ).collect()
    share = sum(len(r[4]) for r in rows) / 6
    assert sum(r.n for r in per_task) == 61
    assert [r.n for r in per_task if r["size"] >= 2 * share] == [1]
    assert len(per_task) == 6
    small = [r["size"] for r in per_task if r.n > 1]
    assert max(small) <= 2 * min(small)
    assert result.per_line.where("status = 'ok' and n = 0").count() == 61
