"""Registered queries that run the streaming job itself over the driver tables,
and their SQL oracles.

The input folders are written from whole tables into the shared checkpoint
folder, the job reads them as files (``availableNow``) and the queries return
what its sinks hold.  The TEXT job runs twice on one checkpoint: documents with
an even id (or none) lie in the watched folder at first, the others arrive before
the restart, so totals are right only if the restart resumes (T-3, T-4).
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovecount.plans.image_queries import scene_sql
from grovecount.plans.image_job import CROPS_FOLDER
from grovecount.plans.lineage import guard_estimate_broadcast
from grovecount.plans.modes import JobOptions
from grovecount.plans.text_queries import DOC_LINE_SUFFIX
from grovecount.session import ensure_checkpoint_dir
from grovecount.sources.images import with_lookup_columns
from grovecount.sources.scenes import scene_images, scene_names
from grovecount.sources.tables import read_table
from grovecount.sources.text import text_column_lines
from grovecount.streaming.job import start_job
from grovecount.streaming.progress import progress_frame
from grovecount.streaming.sinks import read_text_rows, read_totals


@dataclass
class Ran:
    opts: JobOptions
    queries: list[StreamingQuery]


def _folders(spark: SparkSession, label: str) -> dict[str, str]:
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    return {name: f"{root}/{name}" for name in ("input", "output", "checkpoint", "images")}


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _finish(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    return query


def _text_job(spark: SparkSession, d: str) -> Ran:
    at = _folders(spark, "text-job")
    lines = text_column_lines(read_table(spark, d, "documents"), keep=("doc_id",))
    opts = JobOptions(mode="TEXT", input=at["input"], output=at["output"], checkpoint=at["checkpoint"],
                      text_suffix=DOC_LINE_SUFFIX, glob="part-*")
    queries = []
    for arrived in (0, 1):
        lines.where(F.coalesce(F.abs(F.col("doc_id") % 2), F.lit(0)) == arrived).select("value").write.mode("append").text(opts.input)
        queries.append(_finish(start_job(spark, opts, available_now=True)))
    _drop(spark, opts.input)
    return Ran(opts, queries)


def stream_text_totals(spark: SparkSession, d: str) -> DataFrame:
    """O-01, T-1a, T-3, T-4, K-2: totals of the TEXT job after a restart."""
    return read_totals(spark, _text_job(spark, d).opts.output)


def stream_text_rows(spark: SparkSession, d: str) -> DataFrame:
    """K-1, T-6: the text rows of each batch."""
    rows = read_text_rows(spark, _text_job(spark, d).opts.output)
    return rows.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("value").alias("line"))


def stream_progress(spark: SparkSession, d: str) -> DataFrame:
    """T-7: lines read per batch, and whether each batch has its latencies in order."""
    first, second = (progress_frame(spark, q) for q in _text_job(spark, d).queries)
    ordered = (
        (F.col("latency_p50_ms") <= F.col("latency_p95_ms")) & (F.col("latency_p95_ms") <= F.col("latency_p99_ms"))
        & (F.col("latency_p99_ms") <= F.col("latency_max_ms"))
    )
    every = first.unionByName(second).where("num_input_rows > 0")
    return every.select("batch_id", "num_input_rows", F.coalesce(ordered, F.lit(False)).alias("timed"))


def _named_images(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Drawn images with their names; their estimate is that of the rows they are
    drawn from, so they are kept from being broadcast by it."""
    return names.join(guard_estimate_broadcast(scene_images(rows)), "image_id").drop("image_id")


def _image_job(spark: SparkSession, d: str) -> Ran:
    """IMAGES job: every supplier's scene is listed, every third twice; every
    seventh has no image."""
    at = _folders(spark, "image-job")
    rows = read_table(spark, d, "supplier")
    names = scene_names(rows, read_table(spark, d, "nation"), read_table(spark, d, "region"))
    images = _named_images(rows, names.where("image_id % 7 <> 0"))
    # a folder is written by one task, as at ingest: files do not multiply with the tasks that draw
    with_lookup_columns(images).repartition("name_part").write.partitionBy("name_part").parquet(at["images"])
    copies = F.explode(F.sequence(F.lit(0), (F.col("image_id") % 3 == 0).cast("int")))
    names.select("image_name", copies.alias("copy")).select("image_name").write.text(at["input"])
    opts = JobOptions(mode="IMAGES", input=at["input"], output=at["output"], checkpoint=at["checkpoint"], glob="part-*",
                      images_table=at["images"], image_parallelism=spark.sparkContext.defaultParallelism)
    ran = Ran(opts, [_finish(start_job(spark, opts, available_now=True))])
    _drop(spark, at["images"])
    return ran


def stream_image_totals(spark: SparkSession, d: str) -> DataFrame:
    """O-03, O-22, T-5, K-2: circles per type of the IMAGES job."""
    return read_totals(spark, _image_job(spark, d).opts.output)


def stream_image_crops(spark: SparkSession, d: str) -> DataFrame:
    """K-3: the crop table of the IMAGES job."""
    crops = spark.read.parquet(os.path.join(_image_job(spark, d).opts.output, CROPS_FOLDER))
    return crops.select("image_name", "type", "k", "a", "b", "r", "x0", "y0", "x1", "y1", "crop_name")


QUERIES = {
    "stream_text_totals": stream_text_totals,
    "stream_text_rows": stream_text_rows,
    "stream_progress": stream_progress,
    "stream_image_totals": stream_image_totals,
    "stream_image_crops": stream_image_crops,
}

_LINES = r"""
    WITH s AS (SELECT coalesce(abs(doc_id % 2), 0) AS batch_id, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents),
         l AS (SELECT batch_id, unnest(CASE WHEN ls[-1] = '' THEN ls[1:len(ls) - 1] ELSE ls END) AS value FROM s)"""

_LISTED = """
    SELECT s_suppkey AS image_id, lower(r_name) AS type, lower(r_name) || '_' || s_suppkey || '.png' AS image_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

ORACLE = {
    "stream_text_totals": _LINES + """
        SELECT value AS feature, CAST(count(*) AS BIGINT) AS n FROM l WHERE ends_with(value, 'the.') GROUP BY value""",
    "stream_text_rows": _LINES + """
        SELECT batch_id, '(' || value || ',' || count(*) || ')' AS line
        FROM l WHERE ends_with(value, 'the.') GROUP BY batch_id, value""",
    "stream_progress": _LINES + """
        SELECT batch_id, CAST(count(*) AS BIGINT) AS num_input_rows, true AS timed FROM l GROUP BY batch_id""",
    "stream_image_totals": scene_sql(f"""
        SELECT type AS feature, CAST(sum(CASE WHEN image_id % 7 = 0 THEN 0 ELSE coalesce(cnt.n, 0) END
            * CASE WHEN image_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n
        FROM ({_LISTED}) listed LEFT JOIN cnt USING (image_id) GROUP BY 1""", "supplier"),
    "stream_image_crops": scene_sql(f"""
        SELECT image_name, type, box.k, a, b, r, x0, y0, x1, y1,
               type || '_' || image_name || '_' || box.k || '.png' AS crop_name
        FROM ({_LISTED}) listed JOIN box USING (image_id) JOIN circ ON circ.image_id = box.image_id AND circ.k = box.k
        WHERE box.image_id % 7 <> 0""", "supplier"),
}
