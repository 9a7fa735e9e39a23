"""Job modes and options (U-4, U-5, U-6).

A mode maps one bounded batch of input lines to sighting rows
``(feature, n)``; the streaming job calls it once per micro-batch.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from grovecount.plans.detect import DetectParams
from grovecount.plans.image_job import (
    image_counts, rows_named, write_crop_pixels, write_crop_values, write_crops, write_rejects,
)
from grovecount.plans.lineage import RoundTables
from grovecount.plans.text_job import text_sightings
from grovecount.sources.images import find_images, with_lookup_columns
from grovecount.sources.text import manifest_names


@dataclass(kw_only=True)
class JobOptions:
    """Options of the monitoring job (the original's command-line flags).

    The folders are required: on a cluster they must be shared, so there is no
    useful default.  Database credentials have no defaults either.
    """

    input: str
    output: str
    checkpoint: str                         # of the streaming query
    mode: str = "IMAGES"
    job: str = "monitoring orchard"
    trigger: str = "10 seconds"
    window: str = "10 seconds"
    windows: str = "tick"                   # "tick" (foreachBatch stamp) or "clock" (timers, TEXT only)
    text_suffix: str = "orange"
    glob: str = "*.txt"                     # which files of the watched folder are read
    images_dir: str | None = None           # default: <input>/images
    images_table: str | None = None         # parquet written by ingest_images
    image_parallelism: int | None = None    # tasks images are dealt to by size; None: as they are read
    write_crops: bool = True                # K-3: crop table under <output>/processed-images
    crop_pixels: bool = False               # K-3: also the crops' pixels, <output>/processed-images-pixels
    crop_values: bool = False               # K-3: one gray value per crop, <output>/processed-images-values
    max_files_per_trigger: int | None = None  # None: no limit for TEXT, IMAGE_FILES for IMAGES
    compact_every: int = 100                # batches after which the ledger is folded; 0: never
    keep_text_batches: int | None = None    # text folders kept; None: all
    archive_dir: str | None = None          # read files move here; None: they stay
    max_file_age: str | None = None         # older files than this (before the newest) are not read
    tolerated_failures: int = 2             # restarts before the job gives up
    detect: DetectParams = field(default_factory=DetectParams)

    def images_path(self) -> str:
        return self.images_dir or os.path.join(self.input, "images")


# Manifest files of one micro-batch: the paths of their images pass through the driver.
IMAGE_FILES = 100

MODE_LABELS = {"TEXT": "text files", "IMAGES": "images"}


def text_mode(spark: SparkSession, lines: DataFrame, opts: JobOptions, batch_id: int | None = None) -> DataFrame:
    return text_sightings(lines, opts.text_suffix)


def images_mode(spark: SparkSession, lines: DataFrame, opts: JobOptions, batch_id: int | None = None) -> DataFrame:
    names = manifest_names(lines)
    listed = RoundTables(spark, "listed").write(names.distinct(), "names")
    if opts.images_table:
        images = spark.read.parquet(opts.images_table)
        # a manifest can arrive before ingest has its image: the file counts then
        late = listed.join(rows_named(images, listed, ["image_name"]).select("image_name"), "image_name", "left_anti")
        late = find_images(spark, opts.images_path(), late)
        images = images.unionByName(with_lookup_columns(late), allowMissingColumns=True)
    else:
        images = find_images(spark, opts.images_path(), listed)
    result = image_counts(names, images, opts.detect, opts.image_parallelism)
    write_rejects(result, opts.output, batch_id)
    if opts.write_crops and result.detection is not None:
        write_crops(result, opts.output, batch_id)
    if opts.crop_pixels and result.detection is not None:
        write_crop_pixels(result, opts.output, batch_id)
    if opts.crop_values and result.detection is not None:
        write_crop_values(result, opts.output, batch_id)
    return result.per_line.select("feature", "n")


PIPELINES: dict[str, Callable[..., DataFrame]] = {
    "TEXT": text_mode,
    "IMAGES": images_mode,
}


def pipeline_for(mode: str):
    """Case-sensitive lookup; an unknown mode is an error, as in the original."""
    try:
        return PIPELINES[mode]
    except KeyError:
        raise ValueError(f"unknown mode {mode!r}; expected one of {sorted(PIPELINES)}") from None
