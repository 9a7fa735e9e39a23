"""Merkle manifest of a dataset, with a membership proof for every row.

Leaves are row digests.  Per source, leaves in order of id are reduced 16 at a
time to the source's subroot, and the subroots, in order of source, likewise
to one root; only the last run of a level may be short, and a run of one is
hashed too while its level holds several nodes.  H is the lower-case hex
SHA-256 of its inputs concatenated.  A row's proof is its siblings, level by
level and left to right: the other nodes of its run.

How the work is dealt:

* a leaf's place within its source is its place in a distributed sort: rows are
  range-partitioned by (source, id, digest), numbered within the partition, and
  counts per (source, partition) give what lies before.  A source that holds a
  third of all rows is many partitions and never one task's work;
* 4096 neighbouring leaves of a source are a superblock.  Its node comes from
  three grouped steps of 16; the levels above are 1/4096 of the rows, reduced
  and stored level by level;
* each superblock's leaves are then cogrouped with one row that holds the outer
  runs on its path to the root (at most 16 digests per level): one
  ``applyInPandas`` reduces the superblock again, joins both parts of the proof
  and folds it.  A group is at most 4096 digests and one row.

Only heights and the root reach the driver.

Edge cases: a null field is ``-`` in the leaf and null ids come first within
their source, null sources first of all; rows that share an id are ordered by
their digests, and repeated rows are leaves of their own; null and empty text
differ; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovecount.llm.common import sorted_places
from grovecount.plans.lineage import RoundTables

FAN_BITS = 4
FAN = 1 << FAN_BITS
BLOCK_LEVELS = 3  # levels inside a superblock: 16 ** 3 leaves
BLOCK_BITS = FAN_BITS * BLOCK_LEVELS

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def tampered_text(text: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(text.cast("string"), UPPER, LOWER)


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    out = F.lit(15)
    for h in range(14, -1, -1):
        out = F.when(n <= F.lit(FAN**h), F.lit(h)).otherwise(out)
    return out


def _place_leaves(leaves: DataFrame, rounds: RoundTables) -> tuple[DataFrame, DataFrame]:
    """``(leaves with tree, pos, height; trees: tree, source, n, height)``.
    A tree is a source, numbered in order."""
    rows = sorted_places(leaves, ["source", "id", "leaf"], rounds, "leaves")
    runs = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = rounds.write(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    trees = sorted_places(runs.groupBy("source").agg(F.sum("n").alias("n")), ["source"], rounds, "sources")
    # one row per range partition of the sources
    parts = trees.groupBy("part").agg(F.count("*").alias("k"))
    so_far = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("k").over(so_far), F.lit(0)).alias("before"))
    trees = trees.join(parts, "part").select(
        "source", "n", (F.col("before") + F.col("at")).alias("tree"), _height(F.col("n")).alias("height")
    )
    trees = rounds.write(trees, "trees")
    r, t = runs.alias("r"), trees.alias("t")
    runs = r.join(t, F.col("r.source").eqNullSafe(F.col("t.source"))).select(
        "r.source", "part", "first", "before", "tree", "height"
    )
    x, r = rows.alias("x"), runs.alias("r")
    placed = x.join(r, (F.col("x.part") == F.col("r.part")) & F.col("x.source").eqNullSafe(F.col("r.source"))).select(
        "id", "leaf", "altered", "tree", "height", (F.col("before") + F.col("at") - F.col("first")).alias("pos")
    )
    return placed, trees


def _runs_of(nodes: DataFrame) -> DataFrame:
    """``tree, height, parent, run``: the up to 16 digests of each run in order."""
    members = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    return nodes.groupBy("tree", "height", F.shiftright("idx", FAN_BITS).alias("parent")).agg(
        F.transform(members, lambda m: m["hash"]).alias("run")
    )


def _reduced(runs: DataFrame, level: int) -> DataFrame:
    """Nodes of ``level``; trees that are lower than that stay a single node."""
    digest = F.when(F.col("height") >= level, F.sha2(F.array_join("run", ""), 256)).otherwise(F.get("run", F.lit(0)))
    return runs.select("tree", "height", F.col("parent").alias("idx"), digest.alias("hash"))


def _outer_path(blocks: DataFrame, height: int, rounds: RoundTables) -> tuple[DataFrame, DataFrame]:
    """Nodes ``tree, height, idx, hash`` of level 3 up to level ``height``: the
    top nodes, and ``tree, block, step, spot, run`` for every block and level."""
    steps = []
    nodes = blocks
    for level in range(BLOCK_LEVELS + 1, height + 1):
        runs = rounds.write(_runs_of(nodes), f"level{level}")
        down = FAN_BITS * (level - BLOCK_LEVELS - 1)
        path = blocks.where(F.col("height") >= level).select(
            "tree", F.col("idx").alias("block"), F.shiftright("idx", down + FAN_BITS).alias("parent"),
            F.shiftright("idx", down).bitwiseAND(FAN - 1).cast("int").alias("spot"),
        )
        steps.append(path.join(runs.select("tree", "parent", "run"), ["tree", "parent"]).select(
            "tree", "block", F.lit(level).alias("step"), "spot", "run"
        ))
        nodes = _reduced(runs, level)
    return nodes, _union(steps)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def manifest(docs: DataFrame, leaf: Column, altered: Column, id_col: Column, source_col: Column) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row
    of ``docs``.  ``altered`` is the digest of the row as it is found at audit
    (null: unchanged); it and the proof are folded to a root."""
    spark = docs.sparkSession
    rounds = RoundTables(spark, "manifest")
    leaves = docs.select(
        source_col.cast("string").alias("source"), id_col.cast("long").alias("id"), leaf.alias("leaf"),
        altered.alias("altered"),
    )
    placed, trees = _place_leaves(leaves, rounds)
    nodes = placed.select("tree", "height", F.col("pos").alias("idx"), F.col("leaf").alias("hash"))
    for level in range(1, BLOCK_LEVELS + 1):
        nodes = _reduced(_runs_of(nodes), level)
    blocks = rounds.write(nodes, "blocks")
    facts = trees.agg(F.max("height").alias("height"), F.count("*").alias("trees")).first()
    subroots, inner = _outer_path(blocks, facts["height"] or 0, rounds)

    subroots = rounds.write(subroots.select("tree", F.col("hash").alias("subroot")), "subroots")
    top = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("hash"))
    top_height = 0
    tops = []
    top = top.withColumn("height", F.lit(15))  # every level reduces it
    while FAN**top_height < facts["trees"]:
        runs = rounds.write(_runs_of(top), "top")
        down = FAN_BITS * top_height
        path = subroots.select(
            "tree", F.shiftright("tree", down + FAN_BITS).alias("parent"),
            F.shiftright("tree", down).bitwiseAND(FAN - 1).cast("int").alias("spot"),
        )
        top_height += 1
        tops.append(path.join(runs.select("parent", "run"), "parent").select(
            "tree", F.lit(100 + top_height).alias("step"), "spot", "run"
        ))
        top = _reduced(runs, top_height)
    root = top.first()
    root = root["hash"] if root else ""

    every = blocks.select("tree", F.col("idx").alias("block"), "height")
    step = F.struct("step", "spot", "run")
    outer = every.join(subroots, "tree")
    parts = [inner] if inner is not None else []
    for t in tops:
        parts.append(every.select("tree", "block").join(t, "tree"))
    if parts:
        path = _union(parts).groupBy("tree", "block").agg(F.sort_array(F.collect_list(step)).alias("steps"))
        outer = outer.join(path, ["tree", "block"], "left")
    else:
        outer = outer.withColumn("steps", F.lit(None).cast("array<struct<step:int,spot:int,run:array<string>>>"))
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    left = placed.select("tree", block, "pos", "id", "leaf", "altered")
    return (
        left.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
        .applyInPandas(
            _finisher(root),
            "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        )
    )


def _finisher(root: str):
    def finish(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        path = outer.iloc[0]
        digests = leaves["leaf"].tolist()
        # the superblock's own levels
        levels = [digests]
        for _ in range(min(BLOCK_LEVELS, int(path["height"]))):
            below = levels[-1]
            levels.append([H(*below[i:i + FAN]) for i in range(0, len(below), FAN)])
        steps = path["steps"] if path["steps"] is not None else []
        beyond = [(list(s["run"][: s["spot"]]), list(s["run"][s["spot"] + 1:])) for s in steps]
        tail = "".join("".join(left) + "".join(right) for left, right in beyond)
        proofs, folded = [], []
        for i, (leaf, altered) in enumerate(zip(digests, leaves["altered"])):
            node = leaf if altered is None or altered != altered else altered
            proof, at = [], i
            for level in levels[:-1]:
                start = at - at % FAN
                left, right = "".join(level[start:at]), "".join(level[at + 1:start + FAN])
                proof += (left, right)
                node = H(left, node, right)
                at //= FAN
            for left, right in beyond:
                node = H(*left, node, *right)
            proofs.append(H(*proof, tail))
            folded.append(node)
        out = pd.DataFrame({
            "id": leaves["id"].astype("Int64"), "leaf": digests, "subroot": path["subroot"], "root": root,
            "proof_sha256": proofs, "folded_root": folded,
        })
        out["verified"] = out["folded_root"] == root
        return out

    return finish


def op11(spark, sf_dir):
    """Manifest and proofs of all documents; every fifth (by checksum of its id)
    is found with its capitals lost."""
    from grovecount.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents")
    fields = [docs[c] for c in FIELDS]
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    altered = F.when(hit, leaf_digest([*fields[:-1], tampered_text(docs["text"])]))
    out = manifest(docs, leaf_digest(fields), altered, docs["doc_id"], docs["source"])
    return out.withColumnRenamed("id", "doc_id")


def _sql(levels: int = 6, top_levels: int = 4) -> str:
    """The same in SQL, level by level: 16 ** ``levels`` rows of a source and
    16 ** ``top_levels`` sources at most.  A level that holds one node is skipped."""
    def field(c, value=None):
        v = f"CAST({value or c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"

    def leaf(text):
        return "sha256(" + " || ".join([*[field(c) for c in FIELDS[:-1]], field("text", text)]) + ")"

    # CRC-32 of the decimal digits, bit by bit
    bits = "list_reduce(list_concat([xor(c, o)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ord(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, o: {bits}), 4294967295)"
    ctes = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 "
        f"THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM documents)",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, "
        "row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves)",
        "n0 AS (SELECT tree, pos AS idx, leaf AS hash FROM placed)",
    ]

    def grow(name, k):
        # a run and whether its level holds several nodes
        ctes.append(
            f"{name}r{k} AS (SELECT tree, idx // 16 AS parent, list(hash ORDER BY idx) AS run, bool_or(c > 1) AS several "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {name}{k - 1}) GROUP BY tree, idx // 16)"
        )
        ctes.append(
            f"{name}{k} AS (SELECT tree, parent AS idx, CASE WHEN several THEN sha256(array_to_string(run, '')) "
            f"ELSE run[1] END AS hash FROM {name}r{k})"
        )

    def climb(source, name, k, tree, idx, target):
        spot = f"CAST(({idx} // {16 ** (k - 1)}) % 16 AS INTEGER)"
        left, right = f"array_to_string(run[1:{spot}], '')", f"array_to_string(list_slice(run, {spot} + 2, 16), '')"
        ctes.append(
            f"{target} AS (SELECT f.doc_id, f.leaf, f.tree, f.pos, "
            f"CASE WHEN several THEN sha256({left} || node || {right}) ELSE node END AS node, "
            f"CASE WHEN several THEN proof || {left} || {right} ELSE proof END AS proof "
            f"FROM {source} f JOIN {name}r{k} r ON r.tree = {tree} AND r.parent = {idx} // {16 ** k})"
        )

    for k in range(1, levels + 1):
        grow("n", k)
    ctes.append(f"t0 AS (SELECT 0 AS tree, tree AS idx, hash FROM n{levels})")
    for k in range(1, top_levels + 1):
        grow("t", k)
    ctes.append("f0 AS (SELECT doc_id, leaf, tree, pos, coalesce(altered, leaf) AS node, '' AS proof FROM placed)")
    for k in range(1, levels + 1):
        climb(f"f{k - 1}", "n", k, "f.tree", "f.pos", f"f{k}")
    for k in range(1, top_levels + 1):
        climb(f"f{levels + k - 1}", "t", k, "0", "f.tree", f"f{levels + k}")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT f.doc_id, f.leaf, n.hash AS subroot, t.hash AS root, sha256(f.proof) AS proof_sha256,
  f.node AS folded_root, f.node = t.hash AS verified
FROM f{levels + top_levels} f JOIN n{levels} n ON n.tree = f.tree CROSS JOIN t{top_levels} t
"""


OP11_SQL = _sql()
