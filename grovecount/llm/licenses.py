"""Licence scan: ordered signature rules.

Each rule is a regular expression over the normalised words of a text with a
priority, a label and keywords.  A rule runs only on texts that hold all of
its keywords (a substring test), so texts without licence wording cost one
pass.  Overlapping detections are resolved in priority order: a detection whose
interval lies inside one already accepted is suppressed.

The rules come from hand-written lists: licence names (how a version of a
licence is called, with its label), families (the names without a version),
the shapes of a declaration, which apply to every name and family, titles
(a licence's spelled-out name alone), and sentences of the licence texts and
of notices.  A family ranks under every versioned name, so the versioned
detection that contains it suppresses it.

Besides, ``PHRASES`` are counted exactly: every place where the words of a
phrase stand consecutively.

Edge cases: null text counts as empty and gives zero counts and empty labels;
rows with null or repeated ids are scanned like others; texts of any length
are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecount.llm.common import keyed_text

# every place of these word sequences is counted
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# label: (expression over normalised words, keyword it needs)
NAMES = {
    "mit": (r"mit|expat", ""),
    "mit-0": (r"mit no attribution|mit 0", "mit"),
    "apache-1.1": (r"apache(?: software)?(?: license)?(?: version)? v?1 1", "apache"),
    "apache-2.0": (r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?", "apache"),
    "bsd-2-clause": (r"(?:simplified|freebsd|2 clause) bsd|bsd 2 clause", "bsd"),
    "bsd-3-clause": (r"(?:new|modified|revised|3 clause) bsd|bsd 3 clause", "bsd"),
    "bsd-4-clause": (r"(?:original|4 clause) bsd|bsd 4 clause", "bsd"),
    "gpl-1.0": (r"(?:gnu )?(?:general public license|gpl)(?: version)? v?1(?: 0)?", "g"),
    "gpl-2.0": (r"(?:gnu )?(?:general public license|gpl)(?: version)? v?2(?: 0)?", "g"),
    "gpl-3.0": (r"(?:gnu )?(?:general public license|gpl)(?: version)? v?3(?: 0)?", "g"),
    "lgpl-2.0": (r"(?:gnu )?(?:library general public license|lgpl)(?: version)? v?2(?: 0)?", "l"),
    "lgpl-2.1": (r"(?:gnu )?(?:lesser general public license|lgpl)(?: version)? v?2 1", "l"),
    "lgpl-3.0": (r"(?:gnu )?(?:lesser general public license|lgpl)(?: version)? v?3(?: 0)?", "l"),
    "agpl-3.0": (r"(?:gnu )?(?:affero general public license|agpl)(?: version)? v?3(?: 0)?", "a"),
    "gfdl-1.3": (r"(?:gnu )?(?:free documentation license|gfdl)(?: version)? v?1 3", "f"),
    "mpl-1.1": (r"(?:mozilla public license|mpl)(?: version)? v?1 1", "m"),
    "mpl-2.0": (r"(?:mozilla public license|mpl)(?: version)? v?2(?: 0)?", "m"),
    "epl-1.0": (r"(?:eclipse public license|epl)(?: version)? v?1(?: 0)?", "e"),
    "epl-2.0": (r"(?:eclipse public license|epl)(?: version)? v?2(?: 0)?", "e"),
    "cddl-1.0": (r"(?:common development and distribution license|cddl)(?: version)? v?1(?: 0)?", "d"),
    "eupl-1.2": (r"(?:european union public licen[cs]e|eupl)(?: version)? v?1 2", "eu"),
    "cc0-1.0": (r"(?:creative commons )?cc0(?: 1 0)?|creative commons zero", "c"),
    "cc-by-2.0": (r"(?:creative commons attribution|cc by) 2 0", "c"),
    "cc-by-3.0": (r"(?:creative commons attribution|cc by) 3 0", "c"),
    "cc-by-4.0": (r"(?:creative commons attribution|cc by)(?: international)? 4 0", "c"),
    "cc-by-sa-3.0": (r"(?:creative commons attribution share ?alike|cc by sa) 3 0", "c"),
    "cc-by-sa-4.0": (r"(?:creative commons attribution share ?alike|cc by sa)(?: international)? 4 0", "c"),
    "cc-by-nc-4.0": (r"(?:creative commons attribution non ?commercial|cc by nc)(?: international)? 4 0", "c"),
    "cc-by-nd-4.0": (r"(?:creative commons attribution no ?derivatives|cc by nd)(?: international)? 4 0", "c"),
    "cc-by-nc-sa-4.0": (r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0", "c"),
    "cc-by-nc-nd-4.0": (r"(?:creative commons attribution non ?commercial no ?derivatives|cc by nc nd) 4 0", "c"),
    "isc": (r"isc", "isc"),
    "zlib": (r"zlib(?: libpng)?", "zlib"),
    "unlicense": (r"unlicense", "unlicense"),
    "wtfpl": (r"wtfpl|do what the fuck you want to public license", "w"),
    "artistic-2.0": (r"artistic(?: license)?(?: version)? v?2(?: 0)?", "artistic"),
    "bsl-1.0": (r"boost(?: software)?(?: license)?(?: version)? v?1(?: 0)?", "boost"),
    "python-2.0": (r"(?:python software foundation|psf)(?: license)?(?: version)? v?2(?: 0)?", "p"),
    "postgresql": (r"postgresql", "postgresql"),
    "odbl-1.0": (r"(?:open database license|odbl)(?: version)? v?1(?: 0)?", "o"),
    "ofl-1.1": (r"(?:sil )?(?:open font license|ofl)(?: version)? v?1 1", "o"),
    "ms-pl": (r"microsoft public license|ms pl", "m"),
}

# licences named without a version
FAMILIES = {
    "gpl": (r"(?:gnu )?(?:general public licen[cs]e|gpl)", ""),
    "lgpl": (r"(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl)", ""),
    "agpl": (r"(?:gnu )?(?:affero general public licen[cs]e|agpl)", ""),
    "gfdl": (r"(?:gnu )?(?:free documentation licen[cs]e|gfdl)", ""),
    "apache": (r"apache(?: software)?(?: foundation)?", "apache"),
    "bsd": (r"bsd(?: style| type| like)?", "bsd"),
    "mpl": (r"mozilla public licen[cs]e|mpl", ""),
    "epl": (r"eclipse public licen[cs]e|epl", ""),
    "cddl": (r"common development and distribution licen[cs]e|cddl", ""),
    "eupl": (r"european union public licen[cs]e|eupl", ""),
    "odbl": (r"open database licen[cs]e|odbl", ""),
    "ofl": (r"(?:sil )?(?:open font licen[cs]e|ofl)", ""),
    "artistic": (r"(?:perl )?artistic", "artistic"),
    "bsl": (r"boost(?: software)?", "boost"),
    "psf": (r"python software foundation|psf", ""),
    "creative-commons": (r"creative commons", "creative commons"),
    "cc-by": (r"creative commons attribution|cc by", ""),
    "cc-by-sa": (r"creative commons attribution share ?alike|cc by sa", ""),
    "cc-by-nc": (r"creative commons attribution non ?commercial|cc by nc", ""),
    "cc-by-nd": (r"creative commons attribution no ?deriv(?:ative)?s|cc by nd", ""),
    "cc-by-nc-sa": (r"creative commons attribution non ?commercial share ?alike|cc by nc sa", ""),
    "cc-by-nc-nd": (r"creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd", ""),
}

# (name, expression with {n} for the licence, keyword, priority, confidence)
SHAPES = [
    ("identifier", r"spdx license identifier {n}", "spdx", 90, 1.0),
    ("granted", r"(?:licensed|sublicensed) (?:to you )?under (?:the )?(?:terms of )?(?:the |a |an )?{n}", "licensed", 80, 0.95),
    ("released", r"released under (?:the )?(?:terms of )?(?:the |a |an )?{n}", "released", 75, 0.9),
    ("shared", r"(?:distributed|redistributed|published|shared) under (?:the )?(?:terms of )?(?:the |a |an )?{n}",
     "under", 70, 0.9),
    ("available", r"(?:available|covered|provided|usable) (?:by|under) (?:the )?(?:terms of )?(?:the |a |an )?{n}",
     "", 65, 0.85),
    ("subject", r"subject to (?:the )?(?:terms of )?(?:the |a |an )?{n}", "subject", 60, 0.8),
    ("named", r"(?:the |a |an )?{n} licen[cs]e(?:d|s)?", "licen", 50, 0.7),
]

# (label, title, keyword, priority, confidence): a spelled-out name, alone
TITLES = [
    ("apache-2.0", r"apache license(?: version)? v?2(?: 0)?", "apache license", 48, 0.65),
    ("apache-1.1", r"apache software license(?: version)? v?1 1", "apache software license", 48, 0.65),
    ("gpl-2.0", r"gnu general public license(?: version)? v?2(?: 0)?", "gnu general", 48, 0.65),
    ("gpl-3.0", r"gnu general public license(?: version)? v?3(?: 0)?", "gnu general", 48, 0.65),
    ("lgpl-2.1", r"gnu lesser general public license(?: version)? v?2 1", "gnu lesser", 48, 0.65),
    ("lgpl-3.0", r"gnu lesser general public license(?: version)? v?3(?: 0)?", "gnu lesser", 48, 0.65),
    ("agpl-3.0", r"gnu affero general public license(?: version)? v?3(?: 0)?", "gnu affero", 48, 0.65),
    ("gfdl-1.3", r"gnu free documentation license(?: version)? v?1 3", "gnu free", 48, 0.65),
    ("mpl-1.1", r"mozilla public license(?: version)? v?1 1", "mozilla public", 48, 0.65),
    ("mpl-2.0", r"mozilla public license(?: version)? v? ?2(?: 0)?", "mozilla public", 48, 0.65),
    ("epl-1.0", r"eclipse public license(?: version)? v? ?1(?: 0)?", "eclipse public", 48, 0.65),
    ("epl-2.0", r"eclipse public license(?: version)? v? ?2(?: 0)?", "eclipse public", 48, 0.65),
    ("eupl-1.2", r"european union public licen[cs]e(?: version)? v? ?1 2", "european union", 48, 0.65),
    ("bsl-1.0", r"boost software license(?: version)? v?1(?: 0)?", "boost software", 48, 0.65),
    ("artistic-2.0", r"(?:the )?artistic license(?: version)? v?2(?: 0)?", "artistic license", 48, 0.65),
    ("ofl-1.1", r"sil open font license(?: version)? v?1 1", "open font license", 48, 0.65),
    ("cc0-1.0", r"cc0 1 0(?: universal)?", "cc0", 48, 0.65),
    ("ms-pl", r"microsoft public license", "microsoft public", 48, 0.65),
    ("odbl-1.0", r"open database license(?: version)? v?1(?: 0)?", "open database", 48, 0.65),
    ("lgpl", r"gnu (?:lesser|library) general public license", "gnu l", 20, 0.5),
    ("agpl", r"gnu affero general public license", "gnu affero", 20, 0.5),
    ("mpl", r"mozilla public license", "mozilla public", 20, 0.5),
    ("epl", r"eclipse public license", "eclipse public", 20, 0.5),
    ("ofl", r"open font license", "open font license", 20, 0.5),
    ("odbl", r"open database license", "open database", 20, 0.5),
]

# sentences of licence texts and notices
STATEMENTS = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission", 62, 0.9),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy",
     "permission", 62, 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee",
     "permission", 62, 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions", 60, 0.8),
    ("bsd-3-clause", r"neither the name of (?:[^ ]+ ){1,12}nor the names of (?:its|the) contributors",
     "contributors", 62, 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 62, 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", 60, 0.8),
    ("apache-2.0", r"unless required by applicable law or agreed to in writing software", "applicable law", 60, 0.8),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "source code form", 62, 0.9),
    ("gpl", r"(?:this program|it) is free software you can redistribute it and or modify it", "free software", 46, 0.7),
    ("or-later", r"(?:either )?version [0-9](?: [0-9])? (?:of the license )?or (?:at your option )?any later version",
     "later version", 44, 0.6),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 62, 0.9),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly marked", 62, 0.9),
    ("cc0-1.0", r"waived all copyright and related or neighbou?ring rights", "waived", 62, 0.9),
    ("public-domain", r"dedicated (?:the|this) work to the public domain", "dedicated", 60, 0.85),
    ("copyleft", r"you must cause any work that you distribute or publish to be licensed as a whole", "as a whole", 45, 0.6),
    ("proprietary", r"may not be reproduced (?:copied |distributed |transmitted |or ){0,6}(?:in any form )?without",
     "reproduced", 55, 0.7),
    ("proprietary", r"without (?:the )?(?:express |prior )+written (?:permission|consent)", "written", 50, 0.6),
    ("proprietary", r"contains (?:confidential|proprietary) (?:information|trade secrets)", "contains", 55, 0.7),
    ("proprietary", r"for internal use only", "internal use", 55, 0.6),
    ("non-commercial", r"(?:for )?non ?commercial (?:use|purposes?) only", "commercial", 55, 0.7),
    ("no-derivatives", r"no derivative works(?: are)? (?:allowed|permitted)", "derivative", 55, 0.7),
    ("attribution", r"(?:free to|may) share (?:and adapt )?(?:this|the) (?:work|material) (?:with|under) attribution",
     "attribution", 50, 0.6),
    ("liability-disclaimer", r"in no event shall the (?:[^ ]+ ){1,12}be liable", "liable", 35, 0.5),
    ("as-is", r"on an as is basis", "as is", 35, 0.5),
    ("proprietary", r"proprietary and confidential", "confidential", 55, 0.8),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)", "unauthori", 55, 0.7),
    ("public-domain", r"(?:in|into|to) the public domain", "domain", 55, 0.8),
    ("public-domain", r"no rights reserved", "reserved", 58, 0.8),
    ("all-rights-reserved", r"all rights reserved", "reserved", 40, 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 30, 0.4),
    ("warranty-disclaimer", r"without warrant(?:y|ies)(?: or conditions)? of any kind", "warrant", 35, 0.5),
    ("as-is", r"provided (?:by the [a-z ]{1,60} )?as is", "provided", 35, 0.5),
    ("permission-notice", r"permission is hereby granted free of charge", "permission", 45, 0.7),
    ("redistribution", r"redistribution and use in source and binary forms", "redistribution", 45, 0.7),
]


def signature_rules() -> list[tuple[str, str, tuple[str, ...], int, float]]:
    """(label, expression, keywords, priority, confidence), highest priority first."""
    out = [
        (label, shape.format(n=f"(?:{name})"), tuple(k for k in (need, key) if len(k) > 2), priority, confidence)
        for label, (name, key) in NAMES.items()
        for _, shape, need, priority, confidence in SHAPES
    ]
    out += [  # under every versioned name
        (label, shape.format(n=f"(?:{name})"), tuple(k for k in (need, key) if k), priority // 2, 0.9 * confidence)
        for label, (name, key) in FAMILIES.items()
        for _, shape, need, priority, confidence in SHAPES
    ]
    out += [(label, expr, (need,), priority, confidence) for label, expr, need, priority, confidence in TITLES + STATEMENTS]
    return sorted(out, key=lambda r: -r[3])


# a text without any of these runs no rule at all
HINTS = (b"licen", b"reserved", b"copyright", b"spdx", b"public domain", b"warrant", b"released under",
         b"distributed under", b"published under", b"shared under", b"available under", b"covered by",
         b"covered under", b"subject to", b"provided", b"usable under", b"available by", b"usable by", b"unauthori",
         b"confidential", b"permission", b"redistribution", b"advertising materials", b"free software", b"later version",
         b"unencumbered", b"plainly marked", b"neighbo", b"may not be reproduced", b"prior written", b"express written",
         b"trade secrets", b"proprietary information", b"for internal use only", b"commercial use", b"commercial purpose",
         b"derivative works", b"attribution", b"be liable", b"as is basis", b"cc0 1 0", b"nor the names of",
         b"applicable law", b"source code form", b"as a whole")


def detections(words: bytes, rules) -> list[tuple[int, int, int, str, float]]:
    """Accepted (start, end, priority, label, confidence) over `` w1 w2 ... ``."""
    present: dict[str, bool] = {}
    found = []
    for label, expr, keys, priority, confidence in rules:
        for k in keys:
            if k not in present:
                present[k] = k.encode() in words
        if all(present[k] for k in keys):
            found += [(m.start(), m.end(), priority, label, confidence) for m in expr.finditer(words)]
    found.sort(key=lambda d: (-d[2], d[0] - d[1], d[0], d[3]))
    accepted: list[tuple[int, int, int, str, float]] = []
    reach: list[tuple[int, int]] = []  # accepted intervals, none inside another, by start
    from bisect import bisect_right

    for d in found:
        # the accepted interval with the last start <= this start has the largest end
        i = bisect_right(reach, (d[0], 1 << 62)) - 1
        if i >= 0 and reach[i][1] >= d[1]:
            continue
        accepted.append(d)
        reach.insert(i + 1, (d[0], d[1]))
        # intervals that the new one holds no longer matter for containment
        while i + 2 < len(reach) and reach[i + 2][1] <= d[1]:
            del reach[i + 2]
    return accepted


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double"
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the columns of ``SCHEMA``: whole-text word
    count, phrase places and labels, rule labels and the best confidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = [
            (label, re.compile(rb"(?<= )(?:" + expr.encode() + rb")(?= )"), keys, priority, confidence)
            for label, expr, keys, priority, confidence in signature_rules()
        ]
        phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]
        # A-Z to lower case; letters, digits and all bytes beyond ASCII are word bytes
        keep = bytes(
            c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
        )
        for b in batches:
            rows = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").translate(keep).split()
                line = b" " + b" ".join(words) + b" "
                places, base, labels, score = [], set(), set(), 0.0
                for p, label in phrases:
                    word, last, at = 0, 0, line.find(p)
                    while at >= 0:
                        word, last = word + line.count(b" ", last, at), at
                        places.append(word)
                        base.add(label)
                        at = line.find(p, at + 1)
                if any(h in line for h in HINTS):
                    for _, _, _, label, confidence in detections(line, rules):
                        labels.add(label)
                        score = max(score, confidence)
                if base:
                    score = max(score, 0.5)
                rows.append((
                    doc, len(words), len(places), min(places, default=None), max(places, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | labels)), score,
                ))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
            names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op10(spark, sf_dir):
    from grovecount.sources.tables import read_table

    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# the rules' own labels and score are beyond SQL; the base columns are not, and
# tests hold them against this
BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(list_filter(range(len(ws)),
           lambda i: (ws[i+1] = 'cc' AND ws[i+2] = 'by')
             OR (ws[i+1] = 'general' AND ws[i+2] = 'public' AND ws[i+3] = 'license')
             OR (ws[i+1] = 'all' AND ws[i+2] = 'rights' AND ws[i+3] = 'reserved'))) AS i FROM w
), a AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi FROM p GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word
FROM w LEFT JOIN a USING (doc_id)
"""
