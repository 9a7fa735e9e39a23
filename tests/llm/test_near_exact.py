"""SimHash near-duplicates and exact groups against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grovecount.llm import exact, simhash

from .conftest import EDGE_ROWS


def brute_fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, k):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= k:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def brute_groups(rows, k=3):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = components(fps, k)
    least = defaultdict(list)
    for r, (i, _) in zip(roots, rows):
        if i is not None:
            least[r].append(i)
    return sorted(
        ((i, fps[n], min(least[roots[n]], default=None)) for n, (i, _) in enumerate(rows)), key=str
    )


def near_texts(seed, n):
    r = random.Random(seed)
    words = [f"w{j}" for j in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("rows", [EDGE_ROWS, near_texts(1, 160), []])
def test_near_duplicates_equal_brute_force(docs_of, rows):
    got = [(r.id, r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_links_connect_what_brute_force_connects(spark, k):
    r = random.Random(k)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = set()
    for s in seeds:
        for _ in range(25):
            x = s
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), k).collect()
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for e in links:
        a, b = e.src % 2**64, e.dst % 2**64
        assert bin(a ^ b).count("1") <= k
        label[root(a)] = root(b)
    want = components(fps, k)
    mine = [root(x) for x in fps]
    assert len({*zip(want, mine)}) == len(set(want)) == len(set(mine))


def test_long_runs_by_lookup_link_like_short_ones(monkeypatch):
    r = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    for block, (shift, width) in enumerate(simhash.BLOCKS):
        x = r.integers(0, 2**width, 300, dtype=np.uint64) << np.uint64(shift)
        x[:150] = (r.integers(0, 2**10, 150, dtype=np.uint64)) << np.uint64(shift)
        fps = (centre & simhash._kept(block)) | x
        free = [b for b in range(64) if not shift <= b < shift + width]
        fps[::3] ^= np.uint64(1) << r.choice(free, len(fps[::3])).astype(np.uint64)
        fps = np.unique(fps)
        key = (centre & simhash._kept(block)) | np.uint64((block + 1) << shift)
        runs = []
        for limit in (10**9, 1):
            monkeypatch.setattr(simhash, "LOOKUP_RUN", limit)
            a, b = simhash._run_links(np.repeat(key, len(fps)), fps, 3)
            assert (simhash._distance(a, b) <= 3).all()
            label = {int(f): int(f) for f in fps}

            def root(v):
                while label[v] != v:
                    v = label[v]
                return v

            for p, q in zip(a.tolist(), b.tolist()):
                label[root(p)] = root(q)
            runs.append([root(int(f)) for f in fps])
        whole = components([int(f) for f in fps], 3)
        # the forest finds all links of the run, the lookups those that can meet here
        assert len({*zip(whole, runs[0])}) == len(set(whole)) == len(set(runs[0]))
        same = {}
        for v, w in zip(runs[1], runs[0]):
            assert same.setdefault(v, w) == w


def test_one_of_each_near_group_stays(docs_of):
    rows = near_texts(2, 80) + [(200, "alone in the world"), (201, "alone in the world"), (201, "alone in the world")]
    kept = simhash.without_near_duplicates(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    want = sorted({g for _, _, g in brute_groups(rows)})
    assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("rows", [EDGE_ROWS, [(i % 7, f"t{i % 5}") for i in range(60)], []])
def test_exact_groups_equal_brute_force(docs_of, rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: {"min": min, "max": max}[keep]([i for i in g if i is not None], default=None) for t, g in groups.items()}
    want = [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows]
    out = exact.exact_groups(docs_of(rows), keep=keep, fan_in_bits=1).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in out), key=str) == sorted(want, key=str)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_runs_are_sorted_and_merged(spark):
    """Every level of the tree walks sorted rows: no hash aggregate, a sort below each."""
    rows = exact.digests(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))
    runs = rows.select("run", *exact.KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    plan = _plan(exact.merge_runs(exact.merge_runs(runs, "min", 0), "min", 3))
    lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
    names = [x.split("(")[0].split(" ")[0] for x in lines]
    assert "HashAggregate" not in plan and names.count("SortAggregate") == 4
    assert names.count("Sort") == 4 and all(
        any(n == "Sort" for n in names[i + 1:i + 3]) for i, n in enumerate(names) if n == "SortAggregate"
    )


def test_fingerprints_are_dealt_before_they_multiply(spark):
    fps = spark.range(1000).select(F.col("id").alias("fp"))
    plan = _plan(simhash.fingerprint_links(fps, 3))
    assert "REPARTITION_BY_NUM" in plan and "xxhash64(fp" in plan
