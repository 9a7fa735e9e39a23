"""WARC records round trip; the audit finds what differs and nothing else."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grovecount.llm import warc

SCHEMA = "page_id long, url string, html string, file string, offset int, hash string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "h") for r in rows], SCHEMA)


def table(seed, n=300):
    r = random.Random(seed)
    return [(i * 37, f"http://h/{i}", "é" * r.randint(0, 900) + "<p>\r\n\r\n</p>") for i in range(n)]


def test_records_read_back(spark):
    rows = table(1, 40) + [(5, None, None), (6, "http://a\r\nWARC-Type: x", "")]
    got = warc.to_records(pages(spark, rows)).select(*warc.parse_record(F.col("record"))).collect()
    want = [(str(i), (u or "").replace("\r", "").replace("\n", ""), h or "") for i, u, h in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_offsets_are_gapless(spark):
    placed = warc.placed(warc.to_records(pages(spark, table(2) + [(0, "u", "x"), (0, "u", "x"), (None, "u", "y")])))
    ends = {}
    for r in sorted(placed.collect(), key=lambda r: (str(r.file), r.offset)):
        assert r.offset == ends.get(r.file, 0) and r.length == len(r.record)
        ends[r.file] = r.offset + r.length
    assert None in ends and 0 in ends


def audited(spark, records, spoil):
    primary = warc.fixity(records).checkpoint()
    replica = warc.fixity(records.withColumn("record", spoil)).checkpoint()
    return warc.audit(primary, replica)


def test_audit_equals_direct_comparison(spark):
    records = warc.to_records(pages(spark, table(3)))
    r = random.Random(3)
    for bad in ([], [0], [37 * 299], r.sample(range(0, 37 * 300, 37), 20), list(range(0, 37 * 300, 37))):
        lost = set(bad[::3])
        spoil = F.when(F.col("id").isin(*lost or [-5]), F.lit(None)).when(
            F.col("id").isin(*bad or [-5]), F.overlay("record", F.encode(F.lit("#"), "UTF-8"), F.lit(3))
        ).otherwise(F.col("record"))
        got = {(x.id, x.status) for x in audited(spark, records, spoil).collect()}
        assert got == {(i, "missing" if i in lost else "changed") for i in bad}


def test_extra_records_and_empty_replicas(spark):
    records = warc.to_records(pages(spark, table(4, 30)))
    full, none = warc.fixity(records).checkpoint(), warc.fixity(records.where("false")).checkpoint()
    assert {x.status for x in warc.audit(none, full).collect()} == {"extra"}
    assert warc.audit(none, full).count() == 30
    assert {x.status for x in warc.audit(full, none).collect()} == {"missing"}
    assert warc.audit(none, none).count() == 0


def test_only_differing_branches_are_read(spark):
    fixed = warc.fixity(warc.to_records(pages(spark, table(5)))).checkpoint()
    tree = warc.merkle_levels(fixed, warc.tree_heights(fixed))
    assert tree[-1].count() == 1 and tree[0].count() > 1
    assert [t.count() for t in tree] == sorted((t.count() for t in tree), reverse=True)


@pytest.mark.parametrize("ids", [
    [None, 1, 2, 5000], [None, None], [-1, -1024, None, -5000, 7], [2**62, -(2**63), 2**63 - 1, 0, None],
    [2**40, 0], [3] * 40 + [None] * 40 + [9],
], ids=["null", "nulls", "negative", "extremes", "large", "repeated"])
def test_audit_of_unusual_ids(spark, ids):
    """Nulls, negative and 64-bit ids, repeated ids: every record has its own
    place, and exactly the spoilt ones are found."""
    rows = [(i, f"u{n}", f"<p>{n}</p>" + "x" * (n * 977 % 5000)) for n, i in enumerate(ids)]
    records = warc.to_records(pages(spark, rows))
    spoil = F.when(F.col("mark") % 2 == 0, F.overlay("record", F.encode(F.lit("#"), "UTF-8"), F.lit(3)))
    spoil = spoil.when(F.col("mark") % 3 == 0, F.lit(None)).otherwise(F.col("record"))
    marks = {(r.id, r.mark) for r in records.select("id", "mark").collect()}
    want = {("changed" if m % 2 == 0 else "missing", i) for i, m in marks if m % 2 == 0 or m % 3 == 0}
    primary, replica = warc.fixity(records).checkpoint(), warc.fixity(records.withColumn("record", spoil)).checkpoint()
    places = [(r.file, r.offset) for r in primary.collect()]
    assert len(set(places)) == len(ids)
    found = warc.audit(primary, replica).collect()
    assert {(r.status, r.id) for r in found} == want
    assert len(found) == sum(1 for _, m in marks if m % 2 == 0 or m % 3 == 0)
    swapped = warc.audit(replica, primary).collect()
    assert len(swapped) == len(found) and {r.status for r in swapped} <= {"changed", "extra"}
