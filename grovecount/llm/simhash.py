"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its
word shingles.  Two fingerprints at distance ``d <= k`` must meet on a common
variant when both emit every variant within half the radius:

* the 64 bits are cut into three blocks; if the fingerprints differ at all,
  some block holds at least one of the differing bits, so with that block left
  out at most ``k - 1 <= 2 * (k // 2)`` bits differ in the rest;
* each fingerprint therefore emits, per left-out block, all variants of the
  remaining 42-43 bits within radius ``k // 2`` (131 rows for ``k = 3``
  instead of the 2,146 that balls over all 64 bits would take), and each pair
  shares a variant in the middle between them.

Rows are shuffled on the variant.  Each bucket is a sorted run of distinct
fingerprints; true distances are verified there and only the edges of a
spanning forest leave the bucket, so a bucket of ``n`` fingerprints gives at
most ``n - 1`` rows, never all pairs.  Equal fingerprints are collapsed before
anything is emitted, so a group of exact copies of any size is one row.

Edge cases: null text counts as empty and gets fingerprint zero, linked like
any other; rows with a null id get a component but never name one (their
component id is null if no other member has an id); repeated rows give
repeated output rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.llm.common import keyed_text, same_row, text_hash
from grovecount.operators.components import connected_components

SEED = 42
# (shift, width) of the three blocks of a fingerprint
BLOCKS = ((0, 21), (21, 21), (42, 22))
SMALL_RUN = 24  # runs up to this size are compared by shifted arrays
LOOKUP_RUN = 40_000  # longer runs are linked by neighbour lookups


def fingerprint(text: str, shingle: int) -> int:
    """Signed 64-bit SimHash of the whole text (0 for a text without words)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    total = 0
    while True:
        # bounded chunks: memory does not follow the length of the text
        chunk = b"".join([digest(s, SEED) for _, s in zip(range(65536), shingles)])
        if not chunk:
            break
        bits = np.unpackbits(np.frombuffer(chunk, dtype=np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fp, text_hash`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(fps, pa.int64()), b.column("text_hash")], ["id", "fp", "text_hash"]
            )

    rows = keyed_text(docs, id_col, text_col).withColumn("text_hash", text_hash(F.col("text")))
    return rows.mapInArrow(run, "id long, fp long, text_hash long")


def _masks(block: int, radius: int) -> np.ndarray:
    """XOR masks of weight <= radius over the bits outside ``block``."""
    shift, width = BLOCKS[block]
    free = [b for b in range(64) if not shift <= b < shift + width]
    return np.array(
        [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(free, r)], dtype=np.uint64
    )


def _kept(block: int) -> np.uint64:
    shift, width = BLOCKS[block]
    return np.uint64((2**64 - 1) ^ (((1 << width) - 1) << shift))


def _variants(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("fp").to_numpy().view(np.uint64)
            for lo in range(0, len(every), 4096):
                fps = every[lo : lo + 4096]
                for block, (shift, _) in enumerate(BLOCKS):
                    masks = _masks(block, k // 2)
                    # the left-out bits are free in the key: they name the block
                    key = (((fps & _kept(block)) | np.uint64(block + 1 << shift))[:, None] ^ masks[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(np.repeat(fps, len(masks)).view(np.int64))],
                        ["variant", "fp"],
                    )

    return run


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def _forest(fps: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of the distance <= k graph, breadth first: each visited
    fingerprint is compared with the unvisited ones only."""
    out, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = _distance(rest, at) <= k
            if near.any():
                hit = rest[near]
                out.append((np.full(len(hit), at), hit))
                front.extend(hit)
                rest = rest[~near]
    return out


def _lookup_links(fps: np.ndarray, k: int, key: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside one long run, in time linear in its length.

    Members lie within one bit of the variant outside the left-out block, so
    what is left to compare is the block value ``x`` (at most 22 bits):
    members equal to the variant outside the block link to each other at
    block distance <= k and to the others at <= k - 1; the others link to each
    other at <= k - 2 (their outside distance is 0 or 2).  Each case is a
    lookup of all x-variants among the sorted x of the run.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for block, (shift, width) in enumerate(BLOCKS):
        if (int(key) >> shift) & ((1 << width) - 1) == block + 1:
            outside = np.bitwise_count((fps ^ key) & _kept(block))
            own = outside <= k // 2
            _block_lookups(fps[own], outside[own] == 0, shift, width, k, out)
    return out


def _block_lookups(fps, centre, shift, width, k, out):
    x = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    cx, cf = x[centre], fps[centre]
    order = np.argsort(cx)
    cx, cf = cx[order], cf[order]
    ox, first, back = np.unique(x[~centre], return_index=True, return_inverse=True)
    of = fps[~centre][first]
    # others with one x are pairwise at distance 2: link all to the first
    if k >= 2:
        out.append((of[back], fps[~centre]))

    def lookup(ax, af, bx, bf, radius):
        if not len(ax) or not len(bx) or radius < 0:
            return
        for r in range(radius + 1):
            for bits in combinations(range(width), r):
                want = ax ^ np.uint64(sum(1 << b for b in bits))
                at = np.minimum(np.searchsorted(bx, want), len(bx) - 1)
                hit = bx[at] == want
                out.append((af[hit], bf[at[hit]]))

    lookup(cx, cf, cx, cf, k)
    lookup(cx, cf, ox, of, k - 1)
    lookup(ox, of, ox, of, k - 2)


def _run_links(key: np.ndarray, fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of complete runs of equal ``key`` (rows sorted by key)."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    left, right = [], []
    small = np.repeat(size <= SMALL_RUN, size) & np.repeat(size > 1, size)
    sk, sf = key[small], fp[small]
    for off in range(1, SMALL_RUN):
        if len(sk) <= off:
            break
        hit = (sk[off:] == sk[:-off]) & (_distance(sf[off:], sf[:-off]) <= k)
        left.append(sf[:-off][hit])
        right.append(sf[off:][hit])
    for s, n in zip(start[size > SMALL_RUN], size[size > SMALL_RUN]):
        run = np.unique(fp[s : s + n])
        found = _forest(run, k) if len(run) <= LOOKUP_RUN else _lookup_links(run, k, key[s])
        for a, b in found:
            left.append(a)
            right.append(b)
    a = np.concatenate(left) if left else np.empty(0, np.uint64)
    b = np.concatenate(right) if right else np.empty(0, np.uint64)
    keep = a != b
    pairs = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]]), axis=1)
    return pairs[0], pairs[1]


def _bucket_links(k: int):
    def links(key, fp):
        a, b = _run_links(key, fp, k)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []  # an unfinished run carried over batch ends
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("variant").to_numpy().view(np.uint64)
            fp = b.column("fp").to_numpy().view(np.uint64)
            keys.append(key)
            fps.append(fp)
            if key[0] == key[-1] and keys[0][-1] == key[0]:
                continue  # still inside one run
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = len(key) - int(np.argmax(key[::-1] != key[-1]))
            yield links(key[:cut], fp[:cut])
            keys, fps = [key[cut:]], [fp[cut:]]
        if keys:
            yield links(np.concatenate(keys), np.concatenate(fps))

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``src, dst``: links between distinct fingerprints at <= ``max_bits``
    differing bits; enough of them to connect every bucket's components."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must lie in 0..3")
    # dealt out explicitly: small now, these rows multiply in the next step.  By a
    # hash of their own: dealing by fp itself adds nothing to what distinct does,
    # and the optimiser would leave it out
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = fps.select("fp").distinct().repartition(parts, F.xxhash64("fp", F.lit("deal")))
    emitted = distinct.mapInArrow(_variants(max_bits), "variant long, fp long")
    runs = emitted.repartition("variant").sortWithinPartitions("variant")
    return runs.mapInArrow(_bucket_links(max_bits), "src long, dst long").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, fp, text_hash, group, component`` per row; ``component`` is the
    smallest id reachable over links of at most ``max_bits`` differing bits, and
    ``group`` a fingerprint of the component that stands for it."""
    fps = fingerprints(docs, shingle, id_col, text_col).checkpoint()
    least = fps.groupBy("fp").agg(F.min("id").alias("least"))
    labels = connected_components(fingerprint_links(fps, max_bits)).withColumnRenamed("node", "fp")
    # one row per distinct fingerprint: label defaults to itself
    named = least.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = named.groupBy("label").agg(F.min("least").alias("component"))
    classes = named.join(roots, "label").select("fp", F.col("label").alias("group"), "component")
    return attach(fps, classes, "fp").select("id", "fp", "text_hash", "group", "component")


def without_near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id (rows
    without an id come last, then the smallest text hash)."""
    found = near_duplicates(docs, shingle, max_bits, id_col, text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("text_hash"))).alias("f")
    keep = found.groupBy("group").agg(first).select("f.id", "f.text_hash")
    out = docs.join(keep.hint("shuffle_hash"), same_row(docs, id_col, text_col, keep), "left_semi")
    # rows that repeat both id and text are all of them the first
    again = found.groupBy("id", "text_hash").count().where("count > 1").select("id", "text_hash")
    if again.isEmpty():
        return out
    again = again.hint("shuffle_hash")
    single = out.join(again, same_row(out, id_col, text_col, again), "left_anti")
    repeated = out.join(again, same_row(out, id_col, text_col, again), "left_semi").dropDuplicates([id_col, text_col])
    return single.unionByName(repeated)


def attach(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a table unique on ``key``.  A third of all rows may share
    one key: the row side of the sort-merge join is split by adaptive skew
    handling, and the unique side is repeated for the splits only."""
    return rows.join(table.hint("merge"), key, "left")


def op2(spark, sf_dir):
    from grovecount.sources.tables import read_table

    out = near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
