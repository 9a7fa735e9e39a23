from __future__ import annotations

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, id string, size long, seq long, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", f"x{n}", n, -n, "k") for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOC_SCHEMA)

    return make


EDGE_ROWS = [
    (1, "the same text of a few words here"), (2, "the same text of a few words here"),
    (2, "the same text of a few words here"), (3, None), (4, ""), (None, "no id but words"), (None, None),
    (5, "x" * 70_000), (6, "word " * 30_000), (7, "é日本語 ▁ mixed \t\r\n\x0b text"), (8, "\n\n\n"),
]
