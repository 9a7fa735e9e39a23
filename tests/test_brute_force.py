"""Spark pipeline against a direct sequential evaluation of the detector's rules
on a small noisy image (PNG -> image source -> pixels -> ... -> circles).

The sequential version follows SURVEY §2 literally: doubles for magnitude and
angle, an in-place suppression scan (x outer, y inner), set-based hysteresis,
a vote dictionary and greedy acceptance in the fixed order.
"""

from __future__ import annotations

import math
import os
from collections import Counter

import numpy as np
import pytest

from grovecount.plans.detect import DetectParams, detect_circles_in_images
from grovecount.sources.images import read_images

from conftest import write_png

LOW, HIGH, STEPS, THRESHOLD = 20, 25, 100, 0.4


def _noisy_scene(seed: int, amp: int = 25, width: int = 90, height: int = 60) -> np.ndarray:
    rng = np.random.default_rng(seed)
    ys, xs = np.mgrid[0:height, 0:width]
    base = (40 + 0.8 * xs + 0.5 * ys).astype(np.int32)          # shading ramp
    for cx, cy, r, v in [(25, 22, 8, 200), (60, 35, 6, 150), (75, 12, 5, 230)]:
        base[(xs - cx) ** 2 + (ys - cy) ** 2 <= r * r] = v
    rgb = np.stack([base + rng.integers(-amp, amp + 1, base.shape) for _ in range(3)], axis=2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def _sequential(rgb: np.ndarray):
    h, w, _ = rgb.shape
    gray = (rgb.astype(np.int64).sum(axis=2) // 3).T                  # [x][y]
    k = np.array([1, 4, 6, 4, 1])
    pad = np.pad(gray, 2, mode="edge")
    acc = np.zeros((w, h), dtype=np.int64)
    for a in range(5):
        for c in range(5):
            acc += k[a] * k[c] * pad[a:a + w, c:c + h]
    blur = acc // 256
    mag = np.zeros((w, h))
    ang = np.zeros((w, h))
    for x in range(1, w - 1):
        for y in range(1, h - 1):
            gx = int(blur[x + 1][y] - blur[x - 1][y])
            gy = int(blur[x][y + 1] - blur[x][y - 1])
            mag[x][y] = math.sqrt(gx * gx + gy * gy)
            ang[x][y] = math.atan2(gy, gx)
    # the two neighbours compared along each direction bin (4 is the same axis as 0)
    axis = {0: ((-1, 0), (1, 0)), 1: ((-1, -1), (1, 1)), 2: ((0, -1), (0, 1)), 3: ((1, -1), (-1, 1))}
    axis[4] = axis[0]
    for x in range(1, w - 1):                              # scan order matters: in place
        for y in range(1, h - 1):
            folded = ang[x][y] + (math.pi if ang[x][y] < 0 else 0.0)
            d = math.floor(folded / (math.pi / 4) + 0.5)
            if any(mag[x + i][y + j] > mag[x][y] for i, j in axis[d]):
                mag[x][y] = 0
    keep = {(x, y) for x in range(w) for y in range(h) if mag[x][y] > HIGH}
    last = set(keep)
    while last:
        new = set()
        for x, y in last:
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    if mag[x + a][y + b] > LOW and (x + a, y + b) not in keep:
                        new.add((x + a, y + b))
        keep |= new
        last = new
    r_min, r_max = max(1, min(h, w) // 15), max(h, w) // 10
    offsets = [(r, int(r * math.cos(2.0 * math.pi * s / STEPS)), int(r * math.sin(2.0 * math.pi * s / STEPS)))
               for r in range(r_min, r_max + 1) for s in range(STEPS)]
    votes = Counter()
    for x, y in keep:
        for r, dx, dy in offsets:
            votes[(x - dx, y - dy, r)] += 1
    cands = sorted(((a, b, r, n) for (a, b, r), n in votes.items() if n / STEPS >= THRESHOLD),
                   key=lambda c: (-c[3], c[2], c[0], c[1]))
    accepted = []
    for a, b, r, n in cands:
        if all((ea - a) ** 2 + (eb - b) ** 2 >= er * er for ea, eb, er, _ in accepted):
            accepted.append((a, b, r, n))
    return keep, votes, accepted


@pytest.mark.parametrize("stencil", ["bands", "dataframe"])
@pytest.mark.parametrize("seed,amp", [(3, 25), (11, 25), (5, 160)])
def test_pipeline_matches_sequential_rules(spark, workdir, seed, amp, stencil):
    rgb = _noisy_scene(seed, amp)
    folder = os.path.join(workdir, "imgs")
    os.makedirs(folder)
    write_png(os.path.join(folder, f"noisy_{seed}.png"), rgb)
    images = read_images(spark, folder)
    det = detect_circles_in_images(images, params=DetectParams(stencil=stencil))

    keep, votes, accepted = _sequential(rgb)
    assert sorted((r.x, r.y) for r in det.edges.collect()) == sorted(keep)
    got_votes = {(r.a, r.b, r.r): r.votes for r in det.votes.collect()}
    assert got_votes == dict(votes)
    got = [(r.a, r.b, r.r, r.votes) for r in det.circles.orderBy("k").collect()]
    assert got == accepted and len(accepted) > 0


@pytest.mark.parametrize("stencil", ["bands", "dataframe"])
def test_larger_image_wider_radius_range(spark, workdir, stencil):
    # 300 x 200 gives radii 13..30 (18 radii x 100 steps of offsets)
    rng = np.random.default_rng(21)
    ys, xs = np.mgrid[0:200, 0:300]
    base = np.full((200, 300), 30, dtype=np.int32)
    for cx, cy, r in [(80, 90, 18), (210, 110, 25)]:
        base[(xs - cx) ** 2 + (ys - cy) ** 2 <= r * r] = 220
    rgb = np.clip(np.stack([base + rng.integers(-20, 21, base.shape) for _ in range(3)], axis=2), 0, 255)
    rgb = rgb.astype(np.uint8)
    folder = os.path.join(workdir, "big")
    os.makedirs(folder)
    write_png(os.path.join(folder, "big_0.png"), rgb)
    images = read_images(spark, folder)
    det = detect_circles_in_images(images, params=DetectParams(stencil=stencil))
    keep, votes, accepted = _sequential(rgb)
    assert det.edges.count() == len(keep)
    got = [(r.a, r.b, r.r, r.votes) for r in det.circles.orderBy("k").collect()]
    assert got == accepted
    assert {(a, b) for a, b, _, _ in accepted} >= {(80, 90), (210, 110)}


def test_band_height_does_not_change_candidates(spark, workdir):
    from grovecount.operators.image_bands import suppression_inputs_from_images

    rgb = _noisy_scene(9, 60)
    folder = os.path.join(workdir, "bands")
    os.makedirs(folder)
    write_png(os.path.join(folder, "b_0.png"), rgb)
    images = read_images(spark, folder)
    results = []
    for band in (5, 17, 1000):
        rows = suppression_inputs_from_images(images, LOW, band=band).collect()
        results.append(sorted(tuple(r)[1:] for r in rows))
    assert results[0] == results[1] == results[2] and len(results[0]) > 50


def test_acceptance_rounds_on_dense_candidates(spark, workdir):
    from grovecount.operators.overlap import accept_circles

    rgb = _noisy_scene(5, 160)
    folder = os.path.join(workdir, "dense")
    os.makedirs(folder)
    write_png(os.path.join(folder, "dense_0.png"), rgb)
    det = detect_circles_in_images(read_images(spark, folder))
    _, _, accepted = _sequential(rgb)
    split = accept_circles(det.candidates).orderBy("k").collect()
    assert [(r.a, r.b, r.r, r.votes) for r in split] == accepted
    assert [r.k for r in split] == list(range(len(accepted)))
