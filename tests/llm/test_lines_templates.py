"""Lines that recur in templates: short lines, word fields, repetitive documents."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from grovecount.llm import lines

from .conftest import EDGE_ROWS
from .test_lines import BLANKS, boilerplate, mask

def brute(rows, min_docs, leading, min_tokens):
    """Documents are row numbers, in sets; of the lines of a row that share a
    template each counts once."""
    leaves = defaultdict(lambda: defaultdict(set))  # leaf -> masked line -> rows
    for k, (i, t) in enumerate(rows):
        for m in set(mask(x) for x in (t or "").split("\n")) if i is not None else ():
            w = [x for x in re.split(BLANKS, m) if x]
            if len(w) >= min_tokens:
                leaves[(len(w), *w[:leading])][m].add(k)
    first = {}
    for group in leaves.values():
        support = defaultdict(set)
        words = {m: [x for x in re.split(BLANKS, m) if x] for m in group}
        for m, at in group.items():
            for p, x in enumerate(words[m]):
                support[p, x] |= at
        templates = defaultdict(list)
        for m, w in words.items():
            gone = [len(support[p, x]) < min_docs and x != "<*>" for p, x in enumerate(w)]
            templates[tuple("<*>" if g else x for g, x in zip(gone, w))].append((m, sum(gone) <= len(w) // 8))
        for t, ms in templates.items():
            fixed = [(p, x) for p, x in enumerate(t) if x != "<*>"]
            beyond = [len(support[p, x]) for p, x in fixed if p >= leading]
            wide = set().union(*(group[m] for m, _ in ms))
            if not (2 * len(fixed) >= len(t) and len(beyond) >= 2 and len(wide) >= 2 * min_docs and 2 * len(wide) >= min(beyond)):
                ms = [x for x in ms if x[1]]
            found = set().union(*(group[m] for m, _ in ms))
            if len(found) >= min_docs:
                first |= {m: min(rows[k][0] for k in found) for m, _ in ms}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or first.get(mask(x), i) == i]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return sorted(out, key=str)


def letters(i):
    return chr(97 + i // 26) + chr(97 + i % 26)


def test_lines_of_one_and_two_words_recur(docs_of):
    rows = [(i, f"Home\n\nSign  in\nHome page\nnews of its own {chr(97 + i)}") for i in range(12)]
    rows += [(20 + i, "Home\nrare pair") for i in range(9)]
    out = {r.id: r for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
    assert out[0].n_dropped == 0
    assert all(out[i].kept_text == f"\nnews of its own {chr(97 + i)}" for i in range(1, 12))
    # two words in nine documents are no boilerplate yet, and blank lines never are
    assert all(out[20 + i].kept_text == "rare pair" for i in range(9))


def test_short_lines_with_word_fields_recur(docs_of):
    rows = [
        (i, f"Posted by A{letters(i)} B{letters(i)} in News\n"  # 6 tokens, a field of two words
            f"Filed under {letters(i)} by staff\n"  # 5 tokens, one word
            f"Read more about {letters(i)} on our site\n"  # 7 tokens, one word
            f"{letters(i)} wrote this")
        for i in range(30)
    ]
    out = {r.id: r for r in lines.drop_recurring_lines(docs_of(rows)).collect()}
    assert out[0].n_dropped == 0
    assert all(out[i].kept_text == f"{letters(i)} wrote this" for i in range(1, 30))


def test_clean_sentences_that_begin_alike_stay(docs_of):
    """Common words have their support at every position, but not together."""
    r = random.Random(5)
    common, rare = ["the", "of", "and"], [f"w{letters(i)}{letters(j)}" for i in range(60) for j in range(60)]

    def sentence():
        return " ".join(["It was", *(r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(4))])

    rows = [(i, sentence() + "\n" + sentence()) for i in range(2000)]
    # a line may still recur word by word
    n = Counter(x for _, t in rows for x in set(t.split("\n")))
    gone = []
    for o in lines.drop_recurring_lines(docs_of(rows)).collect():
        gone += set(rows[o.id][1].split("\n")) - set(o.kept_text.split("\n"))
    assert all(n[x] >= 10 for x in gone)


def test_a_document_counts_once_for_a_template(docs_of):
    line = "Written by {} for the weekly paper of this town"
    rows = [(1, "\n".join(line.format(letters(i)) for i in range(9))), (2, line.format("someone"))]
    assert all(r.n_dropped == 0 for r in lines.drop_recurring_lines(docs_of(rows)).collect())


def test_a_document_counts_once_for_a_word(docs_of):
    # 'red' would be constant by its lines, and split the lines that hold it off
    line = "The paint of the fence is {} says the shop {}"
    rows = [(1, "\n".join(line.format("red", x) for x in "1a 2b 3c 4d".split()))]
    rows += [(2 + i, line.format(letters(i), "now")) for i in range(9)] + [(20, line.format("red", "now"))]
    got = sorted((r.id, r.kept_text, r.n_lines, r.n_dropped) for r in lines.drop_recurring_lines(docs_of(rows), min_docs=4).collect())
    assert got == sorted(brute(rows, 4, 2, 1))


def lists(seed):
    """Documents that hold many lines of a template each."""
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    shapes = ["Posted by {} {} in News", "Posted by {} today in {}", "Written by {} for the weekly paper of this town", "{} {}", "on {} the 1st"]
    rows = [
        (i, "\n".join(r.choice(shapes).format(r.choice(words), r.choice(words)) for _ in range(r.choice([0, 1, 2, 2, 9]))))
        for i in range(60)
    ]
    return rows + [(3, rows[3][1]), (None, rows[4][1])]


@pytest.mark.parametrize("rows", [EDGE_ROWS, boilerplate(1), lists(1), lists(2), []])
@pytest.mark.parametrize("min_docs", [3, 6])
def test_equals_brute_force_over_sets_of_documents(docs_of, rows, min_docs):
    out = lines.drop_recurring_lines(docs_of(rows), min_docs=min_docs).collect()
    assert sorted(((r.id, r.kept_text, r.n_lines, r.n_dropped) for r in out), key=str) == brute(rows, min_docs, 2, 1)
