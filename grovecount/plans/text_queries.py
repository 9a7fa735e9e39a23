"""Registered text-side queries over the driver tables, and their SQL oracles.

Every query reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecount.functions.text import ends_with, ends_with_any, prefix_before, render_pair
from grovecount.operators.counts import keyed_sum, totals_from_ledger, tumbling_sum
from grovecount.operators.lookup import left_lookup_count
from grovecount.plans.text_job import text_counts
from grovecount.sources.tables import read_table
from grovecount.sources.text import text_column_lines
from grovecount.sources.workload import workload_lines

# Fixed query parameters (stand-ins for "orange" on the driver tables).
DOC_LINE_SUFFIX = "the."
PART_NAME_SUFFIX = "ring"
PAGE_URL_SUFFIXES = (".html", "/")
BRAND_SEPARATOR = "#"
WINDOW = "10 seconds"
EVENTS_EPOCH_DAY = "2024-01-01"


def line_suffix_count(spark: SparkSession, d: str) -> DataFrame:
    """TEXT job on the lines of every document: count per whole kept line."""
    lines = text_column_lines(read_table(spark, d, "documents"))
    return text_counts(lines, DOC_LINE_SUFFIX)


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """O-02 on a text column: every line of every document, empty ones included."""
    return text_column_lines(read_table(spark, d, "documents"), keep=("doc_id",))


def workload_lines_q(spark: SparkSession, d: str) -> DataFrame:
    """O-05: one sighting line per lineitem row."""
    li = read_table(spark, d, "lineitem")
    return workload_lines(li, "l_orderkey", keep=("l_orderkey", "l_linenumber"))


def suffix_filter(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return part.where(ends_with("p_name", PART_NAME_SUFFIX)).select("p_partkey", "p_name")


def multi_suffix_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages")
    return pages.where(ends_with_any("url", PAGE_URL_SUFFIXES)).select("page_id", "url")


def prefix_key(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    return part.select("p_partkey", prefix_before("p_brand", BRAND_SEPARATOR).alias("type"))


def prefix_key_gaps(spark: SparkSession, d: str) -> DataFrame:
    """O-11 on a column where many values lack the separator (null key)."""
    pages = read_table(spark, d, "pages")
    return pages.select("page_id", prefix_before("url", "?").alias("type"))


def tumbling_count(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events")
    return tumbling_sum(events, "ts", "event_type", None, WINDOW)


def _daily_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows as the stream would commit them: events replayed one day per
    micro-batch, each batch adding its 10-second window counts."""
    events = read_table(spark, d, "events").withColumn(
        "batch_id", F.datediff(F.to_date("ts"), F.lit(EVENTS_EPOCH_DAY)).cast("bigint")
    )
    return (
        events.groupBy("batch_id", F.window("ts", WINDOW).start.alias("window_start"),
                       F.col("event_type").alias("feature"))
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    )


def additive_totals(spark: SparkSession, d: str) -> DataFrame:
    return totals_from_ledger(_daily_ledger(spark, d))


def render_rows(spark: SparkSession, d: str) -> DataFrame:
    counts = tumbling_count(spark, d)
    return counts.select("window_start", render_pair("feature", "n").alias("line"))


def lookup_left(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.col("source").alias("feature"))
    per_doc = keyed_sum(read_table(spark, d, "labels"), key="doc_id", value="quality")
    return left_lookup_count(docs, per_doc, "doc_id")


def lookup_type_totals(spark: SparkSession, d: str) -> DataFrame:
    return keyed_sum(lookup_left(spark, d))


def workload_orange_count(spark: SparkSession, d: str) -> DataFrame:
    lines = workload_lines(read_table(spark, d, "lineitem"), "l_orderkey")
    return text_counts(lines)


QUERIES = {
    "line_suffix_count": line_suffix_count,
    "document_lines": document_lines,
    "workload_lines": workload_lines_q,
    "suffix_filter": suffix_filter,
    "multi_suffix_filter": multi_suffix_filter,
    "prefix_key": prefix_key,
    "prefix_key_gaps": prefix_key_gaps,
    "tumbling_count": tumbling_count,
    "additive_totals": additive_totals,
    "render_rows": render_rows,
    "lookup_left": lookup_left,
    "lookup_type_totals": lookup_type_totals,
    "workload_orange_count": workload_orange_count,
}

_BUCKET = "time_bucket(INTERVAL '10 seconds', ts)"

ORACLE = {
    "document_lines": r"""
        WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents)
        SELECT doc_id, unnest(CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END) AS value FROM l""",
    "workload_lines": """
        SELECT l_orderkey, l_linenumber,
               (['ripe orange', 'immature orange', 'leaf', 'branch', 'rotten orange'])
               [CAST((l_orderkey * 7919) % 5 AS INTEGER) + 1] AS value
        FROM lineitem""",
    "line_suffix_count": r"""
        WITH s AS (SELECT string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents),
             l AS (SELECT unnest(CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END) AS value FROM s)
        SELECT value AS feature, CAST(count(*) AS BIGINT) AS n
        FROM l WHERE ends_with(value, 'the.') GROUP BY value""",
    "suffix_filter": """
        SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'ring')""",
    "multi_suffix_filter": """
        SELECT page_id, url FROM pages WHERE ends_with(url, '.html') OR ends_with(url, '/')""",
    "prefix_key": """
        SELECT p_partkey,
               CASE WHEN strpos(p_brand, '#') > 0 THEN split_part(p_brand, '#', 1) END AS type
        FROM part""",
    "prefix_key_gaps": """
        SELECT page_id, CASE WHEN strpos(url, '?') > 0 THEN split_part(url, '?', 1) END AS type
        FROM pages""",
    "tumbling_count": f"""
        SELECT {_BUCKET} AS window_start, {_BUCKET} + INTERVAL '10 seconds' AS window_end,
               event_type AS feature, CAST(count(*) AS BIGINT) AS n
        FROM events GROUP BY ALL""",
    "additive_totals": """
        SELECT event_type AS feature, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""",
    "render_rows": f"""
        SELECT {_BUCKET} AS window_start, '(' || event_type || ',' || count(*) || ')' AS line
        FROM events GROUP BY {_BUCKET}, event_type""",
    "lookup_left": """
        SELECT d.doc_id, d.source AS feature, CAST(coalesce(l.n, 0) AS BIGINT) AS n
        FROM documents d
        LEFT JOIN (SELECT doc_id, sum(quality) AS n FROM labels GROUP BY doc_id) l USING (doc_id)""",
    "lookup_type_totals": """
        SELECT d.source AS feature, CAST(sum(coalesce(l.n, 0)) AS BIGINT) AS n
        FROM documents d
        LEFT JOIN (SELECT doc_id, sum(quality) AS n FROM labels GROUP BY doc_id) l USING (doc_id)
        GROUP BY d.source""",
    "workload_orange_count": """
        WITH w AS (
          SELECT (['ripe orange', 'immature orange', 'leaf', 'branch', 'rotten orange'])
                 [CAST((l_orderkey * 7919) % 5 AS INTEGER) + 1] AS value
          FROM lineitem)
        SELECT value AS feature, CAST(count(*) AS BIGINT) AS n
        FROM w WHERE ends_with(value, 'orange') GROUP BY value""",
}
