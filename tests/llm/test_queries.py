"""Registered queries: SQL oracles, whole tables, and the pipeline stage by stage."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from grovecount.llm import licenses, registry

from .test_lines_templates import brute as brute_lines
from .test_lines import brute as superseded
from .test_near_exact import brute_groups
from .test_quality import brute as brute_counts
from .test_suffix import brute as brute_suffix

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "conversations", "benchmark")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return c


def test_all_are_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(re.match(rf"op{n}_", x) is not None for x in names) == 1
    assert "pipeline" in names
    assert set(registry.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    res = con.execute(registry.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, res.fetchall()))


def test_license_base_columns_equal_sql(spark, con):
    res = con.execute(licenses.BASE_SQL)
    cols = [d[0] for d in res.description]
    got = registry.QUERIES["op10_licenses"](spark, SF).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, res.fetchall()))


@pytest.mark.parametrize("name", ["op2_simhash", "op3_suffix", "op5_lines", "op8_quality"])
def test_documents_queries_equal_brute_force(spark, con, name):
    rows = con.execute("SELECT doc_id, text FROM documents").fetchall()
    out = registry.QUERIES[name](spark, SF).collect()
    if name == "op2_simhash":
        got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in out]
        assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in out)
        want = brute_groups(rows)
    elif name == "op3_suffix":
        import hashlib

        got = [(r.doc_id, r.kept_sha256, r.n_bytes, r.n_removed, r.n_spans) for r in out]
        want = [(i, hashlib.sha256(k).hexdigest(), *rest) for i, k, *rest in brute_suffix(rows)]
    elif name == "op5_lines":
        got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_chars) for r in out]
        want = [(i, n, d, len(t)) for i, t, n, d in brute_lines(rows, 10, 2, 1)]
    else:
        got = [
            (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out
        ]
        want = [(i, *brute_counts(t)) for i, t in rows]
        assert not any(r.kept and r.base_failed for r in out)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op5_lines_on_more_documents(spark):
    """On these the rules of short lines and word fields decide some lines."""
    more = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{more}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_chars) for r in registry.QUERIES["op5_lines"](spark, more).collect()]
    want = [(i, n, d, len(t)) for i, t, n, d in brute_lines(rows, 10, 2, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert want != [(i, n, d, len(t)) for i, t, n, d in superseded(rows, 10, 2, 3)]


def test_pipeline_stages_on_a_fixture(spark, con, tmp_path):
    """Each stage on what the one before kept, against its brute-force version."""
    rows = con.execute("SELECT * FROM documents").fetchall()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r[0]: r[columns.index("text")] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if k == len(corpus_pipeline.STAGES) - 1:
            assert {r.doc_id for r in docs.collect()} == set(kept)
            break
        assert docs.columns == columns, name
        out = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        before = sorted(kept.items())
        if name == "quality_rules":
            failed = {i for i, t in before if brute_counts(t)[-1]}
            assert not failed & set(out) and all(out[i] == kept[i] for i in out)
            # what the learned list rejects besides is labelled or looks like the labelled
            extra = set(kept) - failed - set(out)
            good = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
            assert all(good.get(i, 0) == 0 for i in extra)
        elif name == "line_dedup":
            want = {i: t for i, t, _, d in brute_lines(before, 10, 2, 1) if not d or t.strip()}
            assert out == want
        elif name == "simhash_near_dedup":
            assert set(out) == {g for _, _, g in brute_groups(before)}
        else:
            want = {i: b.decode("utf-8", "ignore") for i, b, _, removed, _ in brute_suffix(before)
                    if not removed or b.decode("utf-8", "ignore").strip()}
            assert out == want
        kept = out
    assert len(con.execute("SELECT 1 FROM documents").fetchall()) > len(kept) > 0


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").where("false").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_handles_nulls_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = docs.limit(20).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars").unionByName(
        docs.limit(10)
    ).unionByName(docs.limit(5).selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0
