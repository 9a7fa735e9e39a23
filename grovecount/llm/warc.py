"""WARC records and a Merkle fixity audit of archive replicas.

``to_records`` lays pages out as WARC/1.1 response records in archive files: a
file holds a range of ids, and a record's offset is the prefix sum of the
lengths before it.  ``parse_record`` reads a record back.

The audit compares two replicas without comparing records:

* a record hashes to SHA-256(offset, length, SHA-256 of its bytes), keyed by its
  file and offset;
* the lowest tree nodes cover ``2 ** LEAF_BITS`` bytes of a file and hash the
  records that start there, in order of offset; each level up joins 16
  neighbouring nodes of a file until a file is one node, then 16 neighbouring
  files, to one root per replica.  A node's key is its range, so a lost record
  changes its own branch and leaves the others aligned;
* roots are compared first; only children of nodes that differ are fetched and
  compared, level by level, down to the records.

Offsets are prefix sums over a distributed sort by file, id, length and
content: a file that holds a third of all records (one id, or none) is many
range partitions.  No step gathers more than 16 nodes or the records that
start in one leaf range.  Levels are small aggregates; a replica is hashed once.

Edge cases: null url or html counts as empty; null ids are one file of their
own, ``file`` null; negative and 64-bit ids are files like others; repeated
rows are records of their own at their own offsets; empty replicas have no root
and agree; a record only one replica has is reported as missing or extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovecount.llm.common import sorted_places
from grovecount.plans.lineage import RoundTables

LEAF_BITS = 16
FAN_BITS = 4
ID_BITS = 10  # ids of one file: 1024

CRLF = "\r\n"


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """One WARC/1.1 record as binary."""
    payload = F.coalesce(html.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: response" + CRLF + "WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">" + CRLF + "WARC-Target-URI: "),
        # a line break in a url would forge a header
        F.translate(F.coalesce(url.cast("string"), F.lit("")), CRLF, ""),
        F.lit(CRLF + "Content-Type: text/html" + CRLF + "Content-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return F.encode(F.concat(head, payload, F.lit(CRLF + CRLF)), "UTF-8")


def to_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``id, file, length, mark, record``: records and the archive file each
    belongs to; ``mark`` orders records of one id."""
    rows = pages.select(
        pages[id_col].cast("long").alias("id"), record_bytes(pages[id_col], pages[url_col], pages[html_col]).alias("record")
    )
    return rows.select(
        "id", F.shiftright("id", ID_BITS).alias("file"),
        F.octet_length("record").cast("long").alias("length"), F.xxhash64("record").alias("mark"), "record",
    )


def placed(records: DataFrame) -> DataFrame:
    """Adds ``offset``, the place of each record in its file."""
    rounds = RoundTables(records.sparkSession, "warc")
    # equal records may change places: their bytes are the same
    rows = records.withColumn("tie", F.monotonically_increasing_id())
    rows = sorted_places(rows, ["file", "id", "length", "mark", "tie"], rounds, "sorted").drop("tie")
    total = rows.groupBy("file", "part").agg(F.sum("length").alias("bytes"))
    earlier = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("file", "part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("file", "part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("length").over(within), F.lit(0)))
    r, t = rows.alias("r"), total.alias("t")
    same = (F.col("r.part") == F.col("t.part")) & F.col("r.file").eqNullSafe(F.col("t.file"))
    return r.join(t, same).select(
        *[F.col("r." + c) for c in records.columns], (F.col("before") + F.col("within")).alias("offset")
    )


def parse_record(record: Column) -> tuple[Column, Column, Column]:
    """(id text, url, payload) of a record's bytes."""
    text = F.decode(record, "UTF-8")
    head = F.substring_index(text, CRLF + CRLF, 1)
    size = F.length(text) - F.length(head) - 8
    return (
        F.regexp_extract(head, r"WARC-Record-ID: <urn:page:([^>]*)>", 1),
        F.regexp_extract(head, r"WARC-Target-URI: ([^\r\n]*)", 1),
        F.substr(text, F.length(head) + 5, size),
    )


def fixity(records: DataFrame) -> DataFrame:
    """``id, file, length, digest, offset, hash`` per record: what the audit
    keeps of a replica.  Bytes are hashed where they are read and do not
    travel.  Records without bytes keep their place but are not there."""
    digests = records.withColumn("digest", F.sha2("record", 256)).drop("record")
    return (
        placed(digests).where("digest is not null").drop("mark")
        .withColumn("hash", F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256))
    )


def _ordered_hash(key: str) -> Column:
    """Hash of a node's children in order; children are (key, hash)."""
    child = F.coalesce(F.col(key).cast("string"), F.lit("-"))  # files without a number
    children = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), child.alias("name"), F.col("hash").alias("h"))))
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["name"], c["h"])), ";"), 256)


def _parents(heights: tuple[int, int]) -> list[tuple[str, Column, Column]]:
    """Per level above the leaf ranges: the child's part that orders a node's
    children, and the node's ``file`` and ``block``.  First a file's blocks are
    joined, then files, then what is left: numbers of both signs and no number."""
    file, block, none = F.col("file"), F.col("block"), F.lit(0).cast("long")
    in_file = [("block", file, F.shiftright(block, FAN_BITS)) for _ in range(heights[0])]
    over_files = [("file", F.shiftright(file, FAN_BITS), none) for _ in range(heights[1])]
    return [*in_file, *over_files, ("file", none, none)]


def tree_heights(*replicas: DataFrame) -> tuple[int, int]:
    """Levels until every file is one node, and until files of one sign are."""
    ends = [r.agg(F.min("file"), F.max("file"), F.max("offset")).first() for r in replicas]
    far = max((e[2] for e in ends if e[2] is not None), default=0) >> LEAF_BITS
    blocks = 0
    while far >> FAN_BITS * blocks:
        blocks += 1
    numbers = [x for e in ends for x in e[:2] if x is not None]
    files = 0
    # a shift by all bits leaves 0 or -1
    while numbers and FAN_BITS * files < 64 and len({x >> FAN_BITS * files for x in numbers}) > 1:
        files += 1
    return blocks, files


def merkle_levels(fixed: DataFrame, heights: tuple[int, int]) -> list[DataFrame]:
    """``file, block, hash`` tables from the leaf ranges (first) to the root
    (last), each stored: together hardly more than the first."""
    rounds = RoundTables(fixed.sparkSession, "merkle")
    leaf = fixed.groupBy("file", F.shiftright("offset", LEAF_BITS).alias("block"))
    out = [rounds.write(leaf.agg(_ordered_hash("offset").alias("hash")), "leaves")]
    for key, file, block in _parents(heights):
        above = out[-1].select(F.col(key).alias("at"), file.alias("file"), block.alias("block"), "hash")
        out.append(rounds.write(above.groupBy("file", "block").agg(_ordered_hash("at").alias("hash")), "level"))
    return out


def _same_node(a: str, b: str) -> Column:
    return F.col(a + ".file").eqNullSafe(F.col(b + ".file")) & (F.col(a + ".block") == F.col(b + ".block"))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Records on which two replicas (outputs of ``fixity``) differ: ``file,
    offset, id, status, digest, found``; status is changed, missing (not in
    ``replica``) or extra (not in ``primary``)."""
    rounds = RoundTables(primary.sparkSession, "audit")
    heights = tree_heights(primary, replica)
    parents = _parents(heights)
    a, b = merkle_levels(primary, heights), merkle_levels(replica, heights)

    def differing(level: int, above: DataFrame | None) -> DataFrame:
        x, y = a[level], b[level]
        if above is not None:
            _, file, block = parents[level]
            x, y = (
                side.select("*", file.alias("f"), block.alias("b")).alias("n").join(
                    above.alias("p"), F.col("f").eqNullSafe(F.col("p.file")) & (F.col("b") == F.col("p.block")),
                    "left_semi",
                ).drop("f", "b")
                for side in (x, y)
            )
        # stored level by level: each step starts from the branches found so far
        both = x.alias("x").join(y.alias("y"), _same_node("x", "y"), "full")
        unlike = both.where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
        there = F.col("x.hash").isNotNull()  # the node's key is null where a side lacks it, or has no number
        return rounds.write(unlike.select(
            *[F.when(there, F.col("x." + c)).otherwise(F.col("y." + c)).alias(c) for c in ("file", "block")]
        ), "differing")

    bad = differing(len(parents), None)
    for level in range(len(parents) - 1, -1, -1):
        bad = differing(level, bad)
    bad = bad.hint("merge").alias("p")
    keep = ["file", "offset", "id", "digest", "hash"]

    def within(side: DataFrame) -> DataFrame:
        side = side.withColumn("block", F.shiftright("offset", LEAF_BITS)).alias("n")
        return side.join(bad, _same_node("n", "p"), "left_semi").select(*keep)

    x, y = within(primary).alias("x"), within(replica).hint("merge").alias("y")
    same = F.col("x.file").eqNullSafe(F.col("y.file")) & (F.col("x.offset") == F.col("y.offset"))
    both = x.join(y, same, "full").where(~F.col("x.hash").eqNullSafe(F.col("y.hash")))
    first = F.col("x.hash").isNotNull()
    return both.select(
        *[F.when(first, F.col("x." + c)).otherwise(F.col("y." + c)).alias(c) for c in ("file", "offset", "id")],
        F.when(F.col("y.hash").isNull(), "missing").when(~first, "extra").otherwise("changed").alias("status"),
        F.col("x.digest").alias("digest"), F.col("y.digest").alias("found"),
    )


def aged_copy(records: DataFrame) -> DataFrame:
    """A replica as storage might have left it, fixed by the record's id: one in
    97 has its last payload byte overwritten, one in 389 cannot be read."""
    spoilt = F.concat(
        F.substring("record", F.lit(1), F.octet_length("record") - 5), F.encode(F.lit("\x00"), "UTF-8"),
        F.encode(F.lit(CRLF + CRLF), "UTF-8"),
    )
    return records.withColumn(
        "record",
        F.when(F.col("id") % 389 == 5, F.lit(None)).when(F.col("id") % 97 == 3, spoilt).otherwise(F.col("record")),
    )


def op4(spark, sf_dir):
    """Archives all pages, ages a second replica, audits it, and reports every
    record with its place, digest and status."""
    from grovecount.sources.tables import read_table

    rounds = RoundTables(spark, "replicas")
    records = to_records(read_table(spark, sf_dir, "pages"))
    primary = rounds.write(fixity(records), "primary")
    replica = rounds.write(fixity(aged_copy(records)), "replica")
    faults = audit(primary, replica).select("file", "offset", "status")
    p, f = primary.alias("p"), faults.hint("merge").alias("f")
    same = F.col("p.file").eqNullSafe(F.col("f.file")) & (F.col("p.offset") == F.col("f.offset"))
    return p.join(f, same, "left").select(
        F.col("p.id").alias("page_id"), "p.file", "p.offset", "p.length", F.col("p.digest").alias("record_sha256"),
        F.coalesce("f.status", F.lit("intact")).alias("status"),
    )


# the records, offsets and digests in SQL; the status follows from how aged_copy
# spoils a record, which is what the audit must find
OP4_SQL = r"""
WITH r AS (
  SELECT page_id, page_id // 1024 AS file,
    encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record
  FROM pages
)
SELECT page_id, file,
  CAST(coalesce(sum(octet_length(record)) OVER (PARTITION BY file ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  octet_length(record) AS length, sha256(record) AS record_sha256,
  CASE WHEN page_id % 389 = 5 THEN 'missing' WHEN page_id % 97 = 3 THEN 'changed' ELSE 'intact' END AS status
FROM r
"""
