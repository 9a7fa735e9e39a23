"""Every registered query against its DuckDB oracle, on the driver tables."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from grovecount.plans.registry import ORACLE_SQL, QUERIES

from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature", "n"]
    assert df.count() >= 0


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) <= set(entry.queries())
    missing = set(QUERIES) - set(ORACLE_SQL)
    assert missing == set()


# Spark type -> DuckDB type name of the same values
_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "StringType()": "VARCHAR",
          "TimestampNTZType()": "TIMESTAMP", "DoubleType()": "DOUBLE", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    sql = ORACLE_SQL[name]
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    otypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: _TYPES.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields} == otypes
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, orows)
