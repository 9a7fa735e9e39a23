"""Registry of the driver queries (name -> callable(spark, data_dir)) and oracles."""

from __future__ import annotations

from grovecount.plans import image_queries, stream_queries, text_queries

QUERIES = {}
QUERIES.update(text_queries.QUERIES)
QUERIES.update(image_queries.QUERIES)
QUERIES.update(stream_queries.QUERIES)

ORACLE_SQL = {}
ORACLE_SQL.update(text_queries.ORACLE)
ORACLE_SQL.update(image_queries.ORACLE)
ORACLE_SQL.update(stream_queries.ORACLE)
