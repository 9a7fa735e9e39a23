"""Line sources: watched folders (O-01, O-03), bounded reads (O-02), and lines
cut out of a text column (documents stand in for multi-line files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecount.functions.text import split_lines

DEFAULT_GLOB = "*.txt"


def read_lines(spark: SparkSession, path: str, glob: str = DEFAULT_GLOB) -> DataFrame:
    """O-02: bounded read of every line of the matching files in ``path``.

    One row per line (``value STRING``); the text source strips CR/LF and
    keeps a final line without a newline.  Files split across tasks by
    ``spark.sql.files.maxPartitionBytes``.
    """
    return spark.read.option("pathGlobFilter", glob).text(path)


def stream_lines(
    spark: SparkSession,
    path: str,
    glob: str = DEFAULT_GLOB,
    max_files_per_trigger: int | None = None,
    archive_dir: str | None = None,
    max_file_age: str | None = None,
    arrival: bool = False,
) -> DataFrame:
    """O-01: unbounded line stream over a watched folder; each file read once.

    The source's seen-file log (in the query checkpoint) gives read-once across
    restarts.  ``max_files_per_trigger`` bounds a micro-batch (back-pressure).
    ``archive_dir`` moves files there once their batch has committed, so that the
    folder listing stays short; ``max_file_age`` (e.g. ``7d``, counted back
    from the newest file) bounds the seen-file log.  ``arrival`` adds the time the
    line's file was written, ``arrived``.
    """
    reader = spark.readStream.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if archive_dir:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive_dir)
    if max_file_age:
        reader = reader.option("maxFileAge", max_file_age)
    lines = reader.text(path)
    if arrival:
        lines = lines.select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    return lines


def manifest_names(lines: DataFrame) -> DataFrame:
    """O-03: a manifest line is one image file name."""
    return lines.select(F.col("value").alias("image_name"))


def text_column_lines(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode a text column into one ``value`` row per line.

    Same line rule as the file source (CRLF, CR, LF; a line break at the end
    starts no further line).
    """
    return df.select(*keep, F.explode(split_lines(text_col)).alias("value"))
