"""Licence scan: base phrases against brute force, rules on examples."""

from __future__ import annotations

import random
import re

import pytest

from grovecount.llm import licenses

from .conftest import EDGE_ROWS

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def brute(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(WORD, text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def phrases(seed):
    r = random.Random(seed)
    words = ["cc", "by", "CC", "BY", "general", "Public", "license", "all", "rights", "reserved", "é", "x9", "gnu"]
    return [(i, "".join(r.choice(words) + r.choice([" ", "-", ", ", "\n", ""]) for _ in range(r.randint(0, 60)))) for i in range(80)]


@pytest.mark.parametrize("rows", [EDGE_ROWS, phrases(1), []])
def test_base_equals_brute_force(docs_of, rows):
    out = licenses.scan(docs_of(rows)).collect()
    got = [(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out]
    assert sorted(got, key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in out:
        assert 0.0 <= r.score <= 1.0
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


@pytest.mark.parametrize("text, label", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("Released under the MIT License.", "mit"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("dedicated to the public domain", "public-domain"),
    ("Licensed under the BSD license.", "bsd"),
    ("Available under the Mozilla Public License.", "mpl"),
    ("Released under the GNU Lesser General Public License.", "lgpl"),
    ("Apache License\nVersion 2.0, January 2004", "apache-2.0"),
    ("Shared under Creative Commons.", "creative-commons"),
    ("Distributed under CC-BY-NC-SA.", "cc-by-nc-sa"),
    ("This program is free software: you can redistribute it and/or modify it", "gpl"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used", "bsd-3-clause"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee", "isc"),
    ("This page may not be reproduced in any form without consent.", "proprietary"),
    ("Altered source versions must be plainly marked as such.", "zlib"),
    ("THE SOFTWARE IS PROVIDED AS IS, without warranty of any kind", "warranty-disclaimer"),
])
def test_rules(docs_of, text, label):
    r = licenses.scan(docs_of([(1, f"Some words. {text} More words.")])).first()
    assert label in r.labels.split(",") and r.score > 0


@pytest.mark.parametrize("text, label, not_label", [
    ("Licensed under the GNU GPL, version 2.", "gpl-2.0", "gpl"),
    ("Licensed under the Apache License 2.0.", "apache-2.0", "apache"),
    ("Released under the Mozilla Public License 2.0.", "mpl-2.0", "mpl"),
    ("Shared under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0", "cc-by-nc-sa"),
    ("Available under a 3-clause BSD license.", "bsd-3-clause", "creative-commons"),
    ("Distributed under CC-BY-NC.", "cc-by-nc", "cc-by-sa"),
])
def test_versions_come_before_families(docs_of, text, label, not_label):
    found = licenses.scan(docs_of([(1, text)])).first().labels.split(",")
    assert label in found and not_label not in found


def test_every_rule_passes_its_own_gates(docs_of):
    """A text made of a sentence or title reaches the rule: hints and keywords let it through."""
    plain = [
        (i, e) for i, (label, e, need, _, _) in enumerate(licenses.TITLES + licenses.STATEMENTS) if not set(e) & set("[{+\\")
    ]
    texts = [(i, re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r" v\?| \?", " ", e)).replace("?", "")) for i, e in plain]
    rules = licenses.TITLES + licenses.STATEMENTS
    reached = 0
    for i, text in texts:
        line = f" {' '.join(text.split())} ".encode()
        if re.search(rb"(?<= )(?:" + rules[i][1].encode() + rb")(?= )", line):
            reached += 1
            assert rules[i][2].encode() in line, rules[i]
            assert any(h in line for h in licenses.HINTS), rules[i]
    assert reached > 30


def test_very_long_text_of_one_phrase(docs_of):
    n = 200_000
    r = licenses.scan(docs_of([(1, "cc by " * n)])).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (2 * n, n, 0, 2 * n - 2)


def test_contained_detections_are_suppressed():
    rules = [
        (label, re.compile(rb"(?<= )(?:" + e.encode() + rb")(?= )"), k, p, c)
        for label, e, k, p, c in licenses.signature_rules()
    ]
    assert len(rules) > 400
    found = licenses.detections(b" licensed under the apache license version 2 0 all rights reserved ", rules)
    assert [d[3] for d in found] == ["apache-2.0", "all-rights-reserved"]
    r = random.Random(2)
    words = "licensed under the mit apache license version 2 0 all rights reserved gnu general public released".split()
    for _ in range(40):
        line = (" " + " ".join(r.choices(words, k=30)) + " ").encode()
        every = [
            (m.start(), m.end(), p, label, c)
            for label, e, k, p, c in rules if all(x.encode() in line for x in k) for m in e.finditer(line)
        ]
        every.sort(key=lambda d: (-d[2], d[0] - d[1], d[0], d[3]))
        kept = []
        for d in every:
            if not any(a[0] <= d[0] and d[1] <= a[1] for a in kept):
                kept.append(d)
        assert licenses.detections(line, rules) == kept


def test_clean_prose_has_no_labels(docs_of):
    r = licenses.scan(docs_of([(1, "A walk in the park under the old trees by the lake, version 2 of the same day.")])).first()
    assert r.labels == "" and r.score == 0.0
