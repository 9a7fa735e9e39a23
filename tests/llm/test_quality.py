"""Quality counts against brute force; the learned list on held-out rows."""

from __future__ import annotations

import random
import re

import pytest

from grovecount.llm import quality

from .conftest import EDGE_ROWS

BLANKS = "[\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    words = [w for w in re.split(BLANKS, text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = {}
    for g in grams:
        counts[g] = counts.get(g, 0) + 1
    hit = set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit.update(range(i, i + 8))
    n, repeat = len(words), len(hit)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeat, n < 20 or 100 * repeat > 30 * n)


def texts(seed):
    r = random.Random(seed)
    out = []
    for i in range(40):
        words = r.choices(["a", "bé", "c#", "日本", "|", "d"], k=r.randint(0, 60))
        if r.random() < 0.5:
            k = r.randint(0, len(words))
            words = words + words[k : k + r.randint(0, 20)]
        t = "".join(w + r.choice([" ", "\n", "\t", "  "]) for w in words)
        out.append((i, t + t[: r.choice([0, 0, 30])]))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [EDGE_ROWS, texts(1), []])
def test_counts_equal_brute_force(spark, docs_of, rows):
    out = quality.judge(docs_of(rows), labels_of(spark, [])).collect()
    got = [(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    # without labels the base rules decide alone
    assert all(r.kept != r.base_failed for r in out)


def sample(n, seed):
    """Bad: many symbols, or short words with few distinct ones."""
    r = random.Random(seed)
    rows, bad = [], {}
    for i in range(n):
        words = ["".join(r.choices("abcdefghij", k=r.randint(4, 9))) for _ in range(r.randint(40, 80))]
        bad[i] = r.random() < 0.3
        if bad[i] and r.random() < 0.5:
            words = [w + "#|" if r.random() < 0.5 else w for w in words]
        elif bad[i]:
            pool = words[:6]
            r.shuffle(words)
            words = [w for j in range(12) for w in r.sample(pool, 5)]
        elif r.random() < 0.2:
            words[3] += "%"
        rows.append((i, " ".join(words)))
    return rows, bad


def test_learned_list_on_held_out_rows(spark, docs_of):
    rows, bad = sample(900, 5)
    seen = [(i, 0 if bad[i] else 1, 0) for i in bad if i % 3] + [(1, None, 0), (None, 0, 0)]
    out = quality.judge(docs_of(rows), labels_of(spark, seen), min_cover=5).collect()
    held = [r for r in out if r.id % 3 == 0 and not r.base_failed]
    rejected = [r for r in held if not r.kept]
    assert sum(bad[r.id] for r in rejected) >= 0.95 * len(rejected)
    assert len(rejected) >= 0.9 * sum(bad[r.id] for r in held)


def test_rules_are_ordered_conditions(spark, docs_of):
    rows, bad = sample(600, 6)
    counts = quality.document_counts(docs_of(rows))
    marked = counts.join(
        spark.createDataFrame([(i, int(b), i % 3 != 0) for i, b in bad.items()], "id long, bad int, grow boolean"), "id"
    )
    rules = quality.learn_rules(marked, min_cover=5)
    assert rules and all(len(r) <= 4 and op in ("<=", ">") for r in rules for _, op, _ in r)
    by_hand = marked.collect()
    flat = quality.judge(docs_of(rows), labels_of(spark, [])).withColumn("v", quality.verdict(rules)).collect()
    values = {
        "symbol_share": lambda r: r.n_symbols / r.word_chars, "distinct_share": lambda r: r.n_distinct / r.n_words,
        "mean_word": lambda r: r.word_chars / r.n_words, "words": lambda r: r.n_words,
        "repeat_share": lambda r: r.n_repeat_words / r.n_words, "dup_line_share": lambda r: r.n_dup_lines / r.n_lines,
        "digit_share": lambda r: r.n_digits / r.word_chars,
    }
    assert len(by_hand) == len(flat)
    for r in flat:
        hit = any(all(values[f](r) <= t if op == "<=" else values[f](r) > t for f, op, t in rule) for rule in rules)
        assert r.v == (not hit)


def test_stage_keeps_passing_rows_whole(spark, docs_of):
    rows = texts(3) + [(3, texts(3)[3][1])]
    out = quality.passing(docs_of(rows), labels_of(spark, []))
    assert out.columns == docs_of(rows).columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted(x for x in rows if not brute(x[1])[-1])


def _labelled(spark, rows):
    """Rows of (bad, grow, n_words, n_symbols, n_distinct); else alike."""
    base = {c: 0 for c in quality.COUNTS} | {"word_chars": 1000, "n_lines": 1}
    return spark.createDataFrame(
        [{**base, "bad": b, "grow": g, "n_words": w, "n_symbols": s, "n_distinct": d} for b, g, w, s, d in rows]
    )


def test_learning_goes_on_after_a_rule_that_fails_pruning(spark):
    """Long documents are bad in the growing set and good in the pruning set."""
    rows = [(0, k % 3 != 0, 100 + k % 7, 0, 50) for k in range(600)]
    rows += [(1, True, 5000, 0, 50)] * 90 + [(0, False, 5000, 0, 50)] * 45
    rows += [(1, k % 3 != 0, 100, 300, 50) for k in range(60)]
    rules = quality.learn_rules(_labelled(spark, rows))
    assert [[(n, op) for n, op, _ in rule] for rule in rules] == [[("symbol_share", ">")]]


def test_a_rare_bad_kind_has_thresholds_of_its_own(spark):
    """One row in a hundred, in one tail of a feature that is spread evenly."""
    rows = [(0, k % 3 != 0, 1000, 0, 400 + k % 600) for k in range(6000)]
    rows += [(1, k % 3 != 0, 1000, 0, 100 + k) for k in range(60)]
    rules = quality.learn_rules(_labelled(spark, rows))
    assert [[(n, op) for n, op, _ in rule] for rule in rules] == [[("distinct_share", "<=")]]
    assert 0.15 < rules[0][0][2] < 0.4
