"""Crops cut from Arrow batches of images: many boxes a batch, large ones in parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

import grovecount.sources.images as images_mod


def _images_with_boxes(n: int) -> pa.RecordBatch:
    boxes = [[{"k": k, "x0": 2 * k, "y0": k, "x1": 2 * k + 20, "y1": k + 10} for k in range(5)] for _ in range(n)]
    data = [np.random.default_rng(i).integers(0, 256, 40 * 30 * 3).astype(np.uint8).tobytes() for i in range(n)]
    return pa.RecordBatch.from_pydict({
        "image_id": pa.array(range(n)), "width": pa.array([40] * n, pa.int32()),
        "n_channels": pa.array([3] * n, pa.int32()), "data": data, "boxes": boxes,
    })


def test_crops_are_emitted_in_batches_of_many_boxes():
    batch = _images_with_boxes(60)
    held = list(images_mod._cut(batch, np.arange(256), 1000))
    out = images_mod._cut_rows(batch.column("image_id"), held).to_pandas()
    assert len(held) == 300 and len(out) == 300 * 200
    for at, k in ((0, 0), (7, 3), (59, 4)):
        crop = out[(out.image_id == at) & (out.k == k)]
        image = np.frombuffer(batch.column("data")[at].as_py(), np.uint8).reshape(30, 40, 3).astype(int)
        assert (crop.v == image[crop.y, crop.x].sum(axis=1) // 3).all()
        assert (crop.x.min(), crop.x.max(), crop.y.min(), crop.y.max()) == (2 * k, 2 * k + 19, k, k + 9)


def test_large_boxes_are_cut_in_parts():
    batch = _images_with_boxes(2).slice(1)  # with an offset into the arrays
    whole = list(images_mod._cut(batch, np.arange(256)))
    parts = list(images_mod._cut(batch, np.arange(256), 50))
    assert len(whole) == 5 and len(parts) == 25 and max(p[-1].size for p in parts) <= 50
    ids = batch.column("image_id")
    assert images_mod._cut_rows(ids, parts).equals(images_mod._cut_rows(ids, whole))
