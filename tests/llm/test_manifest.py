"""Merkle manifest against a direct evaluation of its definition."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from grovecount.llm import manifest
from tests.llm.conftest import EDGE_ROWS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, id long, leaf string, tree int, pos int"


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted result rows."""
    by_source = {}
    for doc_id, text, lang, source, n in rows:
        by_source.setdefault(source, []).append((doc_id, leaf_of(doc_id, source, lang, n, text), text, lang, n))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees.append(tree_of([r[1] for r in by_source[s]]))
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(order):
        for i, (doc_id, leaf, text, lang, n) in enumerate(by_source[s]):
            found = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
                found = leaf_of(doc_id, s, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            proof, at, node = "", i, found
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at - at % 16:at - at % 16 + 16]
                    left, right = "".join(run[:at % 16]), "".join(run[at % 16 + 1:])
                    proof += left + right
                    node = h(left + node + right)
                    at //= 16
            root = top[-1][0]
            out.append((doc_id, leaf, trees[k][-1][0], root, h(proof), node, node == root))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "x", 3, 4) for r in rows], SCHEMA)
    fields = [docs[c] for c in manifest.FIELDS]
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    altered = F.when(hit, manifest.leaf_digest([*fields[:-1], manifest.tampered_text(docs["text"])]))
    out = manifest.manifest(docs, manifest.leaf_digest(fields), altered, docs["doc_id"], docs["source"])
    return sorted((tuple(r) for r in out.collect()), key=str)


def many(n, source, start=0):
    return [(start + i, f"Text {i} Ünd MORE", "en", source, i) for i in range(n)]


@pytest.mark.parametrize("rows", [
    [],
    many(1, "a"),
    many(16, "a") + many(17, "b", 100) + many(1, None, 500) + many(2, "", 600),
    [(i, t, None, "s" if i else None, None) for i, t in EDGE_ROWS],
    many(300, "hot") + [r for k in range(40) for r in many(3, f"s{k}", 1000 + 10 * k)],
    many(5000, "big") + many(257, "z", 9000) + many(3, "big", 0),
], ids=["empty", "one", "runs", "edges", "sources", "superblocks"])
def test_manifest_equals_definition(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_many_superblocks_with_small_blocks(spark, monkeypatch):
    """Outer levels on few rows: a superblock of 16 leaves."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(manifest, "BLOCK_BITS", 4)
    rows = many(700, "a") + many(33, "b", 2000) + many(1, "c", 3000)


    assert run(spark, rows) == brute(rows)


def test_op11_on_documents(spark):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]
    got = sorted((tuple(r) for r in manifest.op11(spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3
