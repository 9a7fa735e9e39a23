"""O-04: images through Spark's ``image`` data source, and their pixel tables.

The source decodes PNG/JPEG on the executors; undecodable files come back
with ``height = width = nChannels = mode = -1`` when ``dropInvalid`` is off.
``data`` is row-major BGR(A): byte ``(y * width + x) * nChannels + c``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovecount.functions.text import file_name

IMAGE_SCHEMA = T.StructType([
    T.StructField("image", T.StructType([
        T.StructField("origin", T.StringType(), True),
        T.StructField("height", T.IntegerType(), True),
        T.StructField("width", T.IntegerType(), True),
        T.StructField("nChannels", T.IntegerType(), True),
        T.StructField("mode", T.IntegerType(), True),
        T.StructField("data", T.BinaryType(), True),
    ]), True),
])


def read_images(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Image files of ``path`` as ``image_name, height, width, n_channels, data``.

    Unreadable files stay in (height -1) so the lookup can report them.  A
    missing folder reads as an empty table (every lookup then says missing).
    """
    if not stream and not _exists(spark, path):
        raw = spark.createDataFrame([], IMAGE_SCHEMA)
    elif stream:
        raw = (spark.readStream.format("image").schema(IMAGE_SCHEMA)
               .option("dropInvalid", False).load(path))
    else:
        raw = spark.read.format("image").option("dropInvalid", False).load(path)
    return _image_columns(raw)


def _image_columns(raw: DataFrame) -> DataFrame:
    return raw.select(
        file_name("image.origin").alias("image_name"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def find_images(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """Images of ``folder`` listed in ``names`` (column ``image_name``): the folder
    is listed without reading any content, and only the files asked for are
    decoded.  The driver sees one path per wanted file, so a batch's manifest
    lines (``max_files_per_trigger``) bound it.
    """
    if not _exists(spark, folder):
        return read_images(spark, folder)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    listing = listing.select("path", file_name("path").alias("image_name"))
    paths = [r.path for r in listing.join(names, "image_name", "left_semi").select("path").collect()]
    if not paths:
        return spark.createDataFrame([], IMAGE_SCHEMA).transform(_image_columns)
    return _image_columns(spark.read.format("image").option("dropInvalid", False).load(paths))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# Folders of an ingested image table: a batch reads those its names fall into.
NAME_PARTS = 64


def name_part(name) -> Column:
    """Folder number of an image name."""
    return F.pmod(F.xxhash64(name), F.lit(NAME_PARTS)).cast("int")


def with_lookup_columns(images: DataFrame) -> DataFrame:
    """Adds ``version`` (content hash, computed once, at ingest) and ``name_part``."""
    return images.withColumns({"version": F.xxhash64("data"), "name_part": name_part("image_name")})


def ingest_images(spark: SparkSession, src: str, dst: str) -> None:
    """Decode a folder of images once into a parquet table keyed by name.

    At scale the job looks images up in this table instead of decoding the
    whole folder per batch.  The table is partitioned by a hash of the name,
    so a lookup of some names opens only their folders, and holds a content
    hash, so versions are told apart without reading the bytes.
    """
    images = with_lookup_columns(read_images(spark, src))
    # a name's folder is written by one task: no more files than folders and input splits
    images.repartition("name_part").write.mode("overwrite").partitionBy("name_part").parquet(dst)


def stream_ingest_images(spark: SparkSession, src: str, dst: str, checkpoint: str,
                         trigger: str = "10 seconds", available_now: bool = False):
    """Decode images once, as they arrive in ``src``, appending them to parquet at ``dst``.

    Runs next to the monitoring job (``JobOptions.images_table = dst``): each
    image is decoded by the file source exactly once (its seen-file log lives
    in ``checkpoint``), and every manifest batch looks names up in the table
    instead of decoding the whole folder again.
    """
    arriving = read_images(spark, src, stream=True).withColumn("ingested_at", F.current_timestamp())
    arriving = with_lookup_columns(arriving).repartition("name_part")
    writer = (arriving.writeStream.format("parquet").partitionBy("name_part")
              .option("path", dst).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)
    return writer.start()


# Boxes are sent to every task up to this size, else shuffled.
BOX_BROADCAST_BYTES = 32 * 1024 * 1024
# Pixel rows per emitted pandas frame: bounds Python memory however large an image is.
PIXEL_CHUNK = 1 << 20


_GRAY_LEVELS: dict[str, np.ndarray] = {}


def java_gray_levels(spark: SparkSession) -> np.ndarray:
    """Gray sample -> the R (= G = B) value Java's ``getRGB`` reports for it.

    For gray images the ``image`` source keeps raw raster samples, while the
    original detector read every pixel through ``getRGB``, which converts a
    gray image's linear samples to sRGB.  The 256 values are taken from the
    JVM itself (a 256 x 1 gray image), so they match that conversion exactly.
    Colour images go through ``getRGB`` in both, so they need no mapping.
    """
    sc = spark.sparkContext
    cached = _GRAY_LEVELS.get(sc.applicationId)
    if cached is not None:
        return cached
    jvm = sc._jvm
    jvm.java.lang.System.setProperty("java.awt.headless", "true")
    kind = jvm.java.awt.image.BufferedImage
    probe = kind(256, 1, kind.TYPE_BYTE_GRAY)
    raster = probe.getRaster()
    for v in range(256):
        raster.setSample(v, 0, 0, v)
    levels = np.array([probe.getRGB(v, 0) & 0xFF for v in range(256)], dtype=np.int32)
    _GRAY_LEVELS[sc.applicationId] = levels
    return levels


def _gray(buf: bytes, channels: int, gray_levels: np.ndarray | None = None) -> np.ndarray:
    """O-13 on a whole image at once: integer mean of R, G, B (alpha ignored)."""
    px = np.frombuffer(buf, dtype=np.uint8).reshape(-1, int(channels))  # bytes or a uint8 view
    if channels >= 3:
        return (px[:, 0].astype(np.int32) + px[:, 1] + px[:, 2]) // 3
    if gray_levels is not None:
        return gray_levels[px[:, 0]]
    return px[:, 0].astype(np.int32)


def _pixel_rows(batches, gray_levels: np.ndarray | None = None):
    """Decoded images -> ``image_id, x, y, v`` frames of at most ``PIXEL_CHUNK`` rows.

    Small images are packed together, large ones are cut into slices, so
    neither a huge image nor many tiny ones make an oversized or tiny frame.
    """
    parts, size = [], 0

    def flush():
        out = pd.concat(parts, ignore_index=True)
        parts.clear()
        return out

    for pdf in batches:
        for ident, width, channels, buf in zip(pdf["image_id"], pdf["width"], pdf["n_channels"], pdf["data"]):
            w, c = int(width), int(channels)
            size_px = len(buf) // c
            for start in range(0, size_px, PIXEL_CHUNK):
                stop = min(size_px, start + PIXEL_CHUNK)
                idx = np.arange(start, stop, dtype=np.int64)
                chunk = np.frombuffer(buf, np.uint8, (stop - start) * c, start * c)
                parts.append(pd.DataFrame({
                    "image_id": ident,
                    "x": (idx % w).astype(np.int32),
                    "y": (idx // w).astype(np.int32),
                    "v": _gray(chunk, c, gray_levels),
                }))
                size += len(idx)
                if size >= PIXEL_CHUNK:
                    yield flush()
                    size = 0
    if parts:
        yield flush()


def _images_with_boxes(images: DataFrame, boxes: DataFrame, id_col: str) -> DataFrame:
    """``image_id, width, n_channels, data, boxes`` of images that have a box with
    content.  The boxes of an image (its accepted circles) travel to the image,
    never its pixels; they are broadcast if they measure under
    ``BOX_BROADCAST_BYTES``."""
    per_image = boxes.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).groupBy("image_id").agg(
        F.collect_list(F.struct("k", "x0", "y0", "x1", "y1")).alias("boxes")
    )
    n_boxes = boxes.count()
    per_image = F.broadcast(per_image) if n_boxes * 40 <= BOX_BROADCAST_BYTES else per_image.hint("merge")
    return readable(images).select(F.col(id_col).alias("image_id"), "width", "n_channels", "data").join(
        per_image, "image_id"
    )


# Rows of pixels, crops and bytes of crops per emitted batch.
CUT_ROWS = 1 << 18
CROPS_PER_BATCH = 4096
CROP_BYTES = 4 << 20


def _cut(batch: pa.RecordBatch, levels: np.ndarray, rows: int | None = None):
    """``(image's place in the batch, k, x0, y0, gray)`` of every box, gray as a
    rows x columns array; boxes over ``rows`` pixels in horizontal parts."""
    widths, channels = (batch.column(c).to_numpy() for c in ("width", "n_channels"))
    data, boxes = batch.column("data"), batch.column("boxes")
    ends = boxes.offsets.to_numpy()
    k, x0, y0, x1, y1 = (boxes.values.field(c).to_numpy() for c in ("k", "x0", "y0", "x1", "y1"))
    for at in range(batch.num_rows):
        w, c = int(widths[at]), int(channels[at])
        image = np.frombuffer(data[at].as_buffer(), np.uint8).reshape(-1, w, c)
        for i in range(ends[at], ends[at + 1]):
            left, right, bottom = int(x0[i]), int(x1[i]), int(y1[i])
            step = max(1, rows // (right - left)) if rows else bottom
            for top in range(int(y0[i]), bottom, step):
                part = np.ascontiguousarray(image[top:min(bottom, top + step), left:right])
                yield at, int(k[i]), left, top, _gray(part, c, levels).reshape(part.shape[:2])


def _cut_rows(ids: pa.Array, held: list) -> pa.RecordBatch:
    """``image_id, k, x, y, v`` of some cut boxes."""
    at, k, x0, y0, height, width = np.array([(a, k, x, y, *g.shape) for a, k, x, y, g in held], dtype=np.int64).T
    size = height * width
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    wide = np.repeat(width, size)
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(np.repeat(at, size))),
        pa.array(np.repeat(k, size).astype(np.int32)),
        pa.array((np.repeat(x0, size) + place % wide).astype(np.int32)),
        pa.array((np.repeat(y0, size) + place // wide).astype(np.int32)),
        pa.array(np.concatenate([g.ravel() for *_, g in held]).astype(np.int32)),
    ], ["image_id", "k", "x", "y", "v"])


def cut_boxes(images: DataFrame, boxes: DataFrame, id_col: str = "image_name") -> DataFrame:
    """O-35 from image bytes: ``image_id, k, x, y, v`` of every pixel inside each
    box (``image_id, k, x0, y0, x1, y1``), cut in the task that holds the bytes."""
    src = _images_with_boxes(images, boxes, id_col)
    schema = T.StructType([
        T.StructField("image_id", src.schema["image_id"].dataType),
        *[T.StructField(c, T.IntegerType()) for c in ("k", "x", "y", "v")],
    ])
    levels = java_gray_levels(images.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for box in _cut(batch, levels, CUT_ROWS):
                held.append(box)
                size += box[-1].size
                if size >= CUT_ROWS:
                    yield _cut_rows(batch.column("image_id"), held)
                    held, size = [], 0
            if held:
                yield _cut_rows(batch.column("image_id"), held)

    return src.mapInArrow(cut, schema)


def cut_values(images: DataFrame, boxes: DataFrame, id_col: str = "image_name") -> DataFrame:
    """K-3: one value per crop, ``image_id, k, width, height, data``: the gray
    bytes of the box, row after row.  Boxes without content have none."""
    src = _images_with_boxes(images, boxes, id_col)
    schema = T.StructType([
        T.StructField("image_id", src.schema["image_id"].dataType),
        *[T.StructField(c, T.IntegerType()) for c in ("k", "width", "height")],
        T.StructField("data", T.BinaryType()),
    ])
    levels = java_gray_levels(images.sparkSession)
    names = schema.names

    def values(ids: pa.Array, held: list) -> pa.RecordBatch:
        at, k, width, height, data = zip(*held)
        numbers = [pa.array(c, pa.int32()) for c in (k, width, height)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *numbers, pa.array(data, pa.binary())], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for at, k, _, _, gray in _cut(batch, levels):
                held.append((at, k, gray.shape[1], gray.shape[0], gray.astype(np.uint8).tobytes()))
                size += gray.size
                if len(held) == CROPS_PER_BATCH or size >= CROP_BYTES:
                    yield values(batch.column("image_id"), held)
                    held, size = [], 0
            if held:
                yield values(batch.column("image_id"), held)

    return src.mapInArrow(cut, schema)


def readable(images: DataFrame) -> DataFrame:
    return images.where(F.col("height") > 0)


def image_dims(images: DataFrame, id_col: str = "image_name") -> DataFrame:
    return readable(images).select(F.col(id_col).alias("image_id"), "width", "height")


def image_pixels(images: DataFrame, id_col: str = "image_name") -> DataFrame:
    """Pixel table ``image_id, x, y, v`` (v = gray level 0..255), one row per pixel.

    Decoding runs in ``mapInPandas`` over Arrow batches of images (bounded in
    bytes by ``spark.sql.execution.arrow.maxBytesPerBatch``) and emits bounded
    frames; the image bytes stop here, no later stage carries them.
    """
    src = readable(images).select(F.col(id_col).alias("image_id"), "width", "n_channels", "data")
    schema = T.StructType([
        T.StructField("image_id", src.schema["image_id"].dataType),
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("v", T.IntegerType()),
    ])
    levels = java_gray_levels(images.sparkSession)

    def decode(batches):
        return _pixel_rows(batches, levels)

    return src.mapInPandas(decode, schema)
