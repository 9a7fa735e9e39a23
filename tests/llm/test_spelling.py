"""Spelling variants against a direct comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from grovecount.llm import spelling
from tests.conftest import SF_SMALL

from .conftest import EDGE_ROWS


def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_variants(n):
    """Neighbours by deleting or masking one position: words meet on the result."""
    meet = defaultdict(set)
    for w in n:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + w[i + 1:]].add(w)
            meet[w[:i] + "*" + w[i + 1:]].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def test_variants_equal_brute_force(spark):
    r = random.Random(5)
    n = {}
    for _ in range(150):
        base = "".join(r.choice("abç") for _ in range(r.choice((7, 8, 9, 12, 31, 32, 33, 34, 70))))
        n[base] = r.choice((2, 30, 700))
        for _ in range(6):
            at, c = r.randrange(len(base)), r.choice("abç")
            w = r.choice((base[:at] + base[at + 1:], base[:at] + c + base[at:], base[:at] + c + base[at + 1:]))
            if len(w) >= 7:
                n.setdefault(w, r.choice((2, 2, 3, 40, 700)))
    n.update({"aaaaaaa": 2000, "aaaaaaaa": 200, "aaaaaaaaa": 20, "aaaaaaaaaa": 2, "bbbbbbb": 5, "z" * 900: 2, "z" * 901: 90})
    got = sorted(tuple(x) for x in spelling.spelling_variants(
        spark.createDataFrame(list(n.items()), "word string, n long")).collect())
    assert got == brute_variants(n)
    assert any(x[1] for x in got)
    assert {x[0]: x[2] for x in got}["aaaaaaaaaa"] == "aaaaaaa"
    assert spelling.spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_tiles_report_every_pair_once(spark):
    r = random.Random(6)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(7, 10))) for _ in range(400)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = sorted((x.word, x.other) for x in spelling.near_words(df).collect())
    assert got == sorted((a, b) for a in words for b in words if one_edit(a, b))


def test_counts_with_edge_rows(spark, docs_of):
    rows = EDGE_ROWS + [(i, "Variants VARIANTS variants Über-Grösse éclairée x" * 3) for i in range(200)] + [(None, None)]
    got = {x.word: x.n for x in spelling.word_counts(docs_of(rows)).collect()}
    assert got == brute_counts(rows) and len(got) > 5


def test_op13_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute_variants(brute_counts(rows))
    got = sorted(tuple(r) for r in spelling.op13(spark, SF_SMALL).collect())
    assert got == want and sum(1 for x in got if x[1]) > 0
