from __future__ import annotations

import os
import struct
import sys
import tempfile
import zlib

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from grovecount.session import build_session  # noqa: E402
from grovecount.streaming.timers import ROCKSDB_PROVIDER  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # spark.checkpoint.dir: the configured one if any, else a local folder
    # chosen by build_session (local mode only)
    s = build_session(
        master="local[*]",
        shuffle_partitions=8,
        extra={"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER},
    )
    yield s
    s.stop()


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="grovecount-test-")


def disc_scene(width: int, height: int, discs) -> np.ndarray:
    """Gray image (height x width) with white discs ``(cx, cy, r)`` on black."""
    ys, xs = np.mgrid[0:height, 0:width]
    img = np.zeros((height, width), dtype=np.int32)
    for cx, cy, r in discs:
        img[(xs - cx) ** 2 + (ys - cy) ** 2 <= r * r] = 255
    return img


def pixels_frame(spark, images: dict):
    """Pixel table ``image_id, x, y, v`` from {image_id: 2-D gray array}."""
    parts = []
    for image_id, img in images.items():
        h, w = img.shape
        ys, xs = np.mgrid[0:h, 0:w]
        parts.append(pd.DataFrame({
            "image_id": image_id, "x": xs.ravel().astype("int32"),
            "y": ys.ravel().astype("int32"), "v": img.ravel().astype("int32"),
        }))
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf, "image_id string, x int, y int, v int")


def dims_frame(spark, images: dict):
    rows = [(k, int(v.shape[1]), int(v.shape[0])) for k, v in images.items()]
    return spark.createDataFrame(rows, "image_id string, width int, height int")


def write_png(path: str, rgb: np.ndarray) -> None:
    """8-bit RGB (h x w x 3) or gray (h x w) PNG, filter 0 on every row (zlib + struct only)."""
    h, w = rgb.shape[:2]
    colour_type = 2 if rgb.ndim == 3 else 0
    raw = b"".join(b"\x00" + rgb[y].astype(np.uint8).tobytes() for y in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n")
        f.write(chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour_type, 0, 0, 0)))
        f.write(chunk(b"IDAT", zlib.compress(raw)))
        f.write(chunk(b"IEND", b""))


def gray_to_rgb(img: np.ndarray) -> np.ndarray:
    return np.repeat(img[:, :, None], 3, axis=2)
