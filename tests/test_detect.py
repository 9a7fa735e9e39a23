"""Circle pipeline on synthetic scenes with known answers (FIXTURES §5)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from grovecount.operators.crops import crop_boxes, crop_pixels
from grovecount.operators.hough import candidates, circle_offsets, vote_counts
from grovecount.operators.hysteresis import grow_edges
from grovecount.operators.overlap import accept_circles
from grovecount.operators.stencil import blur, gradient
from grovecount.operators.thinning import thin
from grovecount.plans.detect import DetectParams, detect_circles, edge_pixels

from conftest import dims_frame, disc_scene, pixels_frame

SCENES = {
    "one": [(60, 45, 9)],
    "three": [(25, 25, 10), (60, 60, 9), (95, 25, 8)],
    "blank": [],
    "edge": [(3, 45, 9)],
}
# scene -> (edges in-place, edges snapshot, vote cells, cells >= 0.4, accepted (a, b, r, votes))
EXPECTED = {
    "one": (95, 64, 8036, 22, [(60, 45, 10, 72)]),
    "three": (297, 192, 24265, 66, [(25, 25, 11, 80), (60, 60, 10, 72), (95, 25, 8, 60)]),
    "blank": (0, 0, 0, 0, []),
    "edge": (57, 37, 6629, 5, [(3, 45, 10, 44)]),
}


@pytest.fixture(scope="module")
def scenes(spark):
    imgs = {name: disc_scene(120, 90, discs) for name, discs in SCENES.items()}
    return pixels_frame(spark, imgs).cache(), dims_frame(spark, imgs)


def _by_image(df, col=None):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, []).append(r if col is None else r[col])
    return out


def test_edges_inplace_and_snapshot(spark, scenes):
    px, _ = scenes
    inplace = _by_image(edge_pixels(px, DetectParams(thinning="inplace")))
    snap = _by_image(edge_pixels(px, DetectParams(thinning="snapshot")))
    for name, (n_in, n_snap, *_rest) in EXPECTED.items():
        assert len(inplace.get(name, [])) == n_in, name
        assert len(snap.get(name, [])) == n_snap, name


def test_votes_candidates_and_circles(spark, scenes):
    px, dims = scenes
    det = detect_circles(px, dims)
    cells = {r.image_id: r.c for r in det.votes.groupBy("image_id").count().withColumnRenamed("count", "c").collect()}
    cands = {r.image_id: r.c for r in det.candidates.groupBy("image_id").count()
             .withColumnRenamed("count", "c").collect()}
    circles = {}
    for r in det.circles.orderBy("image_id", "k").collect():
        circles.setdefault(r.image_id, []).append((r.a, r.b, r.r, r.votes))
    counts = {r.image_id: r.n for r in det.counts.collect()}
    for name, (_, _, n_cells, n_cands, accepted) in EXPECTED.items():
        assert cells.get(name, 0) == n_cells, name
        assert cands.get(name, 0) == n_cands, name
        assert circles.get(name, []) == accepted, name
        assert counts[name] == len(accepted), name


def test_blur_is_exact_integer_binomial(spark):
    rng = np.random.default_rng(7)
    img = rng.integers(0, 256, size=(9, 11)).astype(np.int32)
    got = {(r.x, r.y): r.v for r in blur(pixels_frame(spark, {"r": img})).collect()}
    k = np.array([1, 4, 6, 4, 1])
    h, w = img.shape
    for y in range(h):
        for x in range(w):
            acc = 0
            for a in range(5):
                for b in range(5):
                    xn = min(max(x + a - 2, 0), w - 1)
                    yn = min(max(y + b - 2, 0), h - 1)
                    acc += img[yn, xn] * k[a] * k[b]
            assert got[(x, y)] == acc // 256


def test_gradient_border_and_direction(spark):
    img = np.zeros((5, 5), dtype=np.int32)
    img[:, 3:] = 100  # vertical step: horizontal gradient, bin 0
    g = {(r.x, r.y): (r.mag2, r.dir) for r in gradient(pixels_frame(spark, {"s": img})).collect()}
    assert g[(0, 2)] == (0, 0) and g[(4, 2)] == (0, 0) and g[(2, 0)] == (0, 0)
    assert g[(2, 2)] == (100 * 100, 0)
    img_t = img.T.copy()  # horizontal step: vertical gradient, bin 2
    gt = {(r.x, r.y): (r.mag2, r.dir) for r in gradient(pixels_frame(spark, {"t": img_t})).collect()}
    assert gt[(2, 2)] == (100 * 100, 2)


def test_inplace_thinning_differs_from_snapshot(spark):
    # a plateau of equal-magnitude ridge: in-place keeps chain survivors that snapshot would not
    img = disc_scene(40, 40, [(20, 20, 9)])
    grad = gradient(blur(pixels_frame(spark, {"d": img})))
    a = thin(grad, 20, "inplace").count()
    b = thin(grad, 20, "snapshot").count()
    assert a >= b > 0


def test_hysteresis_grows_only_connected_weak(spark):
    rows = [("i", 5, 5, 900), ("i", 6, 5, 500), ("i", 7, 6, 450), ("i", 20, 20, 450), ("i", 8, 7, 300)]
    thinned = spark.createDataFrame(rows, "image_id string, x int, y int, mag2 int")
    got = sorted((r.x, r.y) for r in grow_edges(thinned, 20, 25).collect())
    assert got == [(5, 5), (6, 5), (7, 6)]


def test_offsets_keep_duplicate_weight(spark):
    radii = spark.createDataFrame([(1,), (3,)], "r int")
    off = circle_offsets(radii, 100)
    weights = {r.r: r.s for r in off.groupBy("r").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s")
               .collect()}
    assert weights == {1: 100, 3: 100}
    assert off.where("r = 1").count() < 100  # duplicates merged into weight


CANDS = "image_id string, a int, b int, r int, votes long"


def greedy(cands):
    """Sequential acceptance: the definition the rounds must reproduce."""
    out = {}
    for i, a, b, r, v in sorted(cands, key=lambda c: (c[0], -c[4], c[3], c[1], c[2])):
        own = out.setdefault(i, [])
        if all((a - p) ** 2 + (b - q) ** 2 >= s * s for p, q, s, _ in own):
            own.append((a, b, r, v))
    return sorted((i, k, *c) for i, own in out.items() for k, c in enumerate(own))


def test_greedy_acceptance_order_and_overlap(spark):
    rows = [("i", 10, 10, 5, 50), ("i", 11, 10, 6, 60), ("i", 30, 30, 4, 40), ("i", 10, 16, 5, 50)]
    out = accept_circles(spark.createDataFrame(rows, CANDS)).orderBy("k").collect()
    # (11,10,6) first by votes; (10,10,5) inside it; (10,16,5): distance^2 = 1+36 = 37 >= 36 -> kept
    assert [(r.k, r.a, r.b, r.r) for r in out] == [(0, 11, 10, 6), (1, 10, 16, 5), (2, 30, 30, 4)]


def test_acceptance_rounds_equal_sequential_on_dense_candidates(spark):
    rng = np.random.default_rng(8)
    rows = {
        (f"i{i}", int(a), int(b), int(r)): int(v)
        for i, size in enumerate((400, 60, 1))
        for a, b, r, v in zip(*(rng.integers(lo, hi, size) for lo, hi in ((-5, 90), (-5, 60), (2, 13), (40, 60))))
    }
    cands = [(*k, v) for k, v in rows.items()]
    for block in (512, 32, 5):
        out = sorted(tuple(r) for r in accept_circles(spark.createDataFrame(cands, CANDS), block=block).collect())
        assert out == greedy(cands), block
    assert accept_circles(spark.createDataFrame([], CANDS)).count() == 0


def test_crop_boxes_clamp_and_pixels(spark):
    circles = spark.createDataFrame([("i", 0, 2, 2, 3, 40), ("i", 1, 9, 9, 1, 40)],
                                    "image_id string, k int, a int, b int, r int, votes long")
    dims = spark.createDataFrame([("i", 10, 10)], "image_id string, width int, height int")
    boxes = {r.k: (r.x0, r.y0, r.x1, r.y1) for r in crop_boxes(circles, dims).collect()}
    assert boxes == {0: (0, 0, 5, 5), 1: (8, 8, 10, 10)}
    img = np.arange(100, dtype=np.int32).reshape(10, 10)
    from conftest import pixels_frame as pf
    cp = crop_pixels(crop_boxes(circles, dims), pf(spark, {"i": img}))
    assert cp.where("k = 0").count() == 25 and cp.where("k = 1").count() == 4


def test_vote_fallback_without_broadcast_matches(spark, scenes, monkeypatch):
    import grovecount.operators.hough as hough

    px, dims = scenes
    edges = edge_pixels(px.where("image_id = 'one'"))
    d1 = dims.where("image_id = 'one'")
    a = sorted(tuple(r) for r in vote_counts(edges, d1).collect())
    monkeypatch.setattr(hough, "MAX_BROADCAST_BYTES", 0)
    b = sorted(tuple(r) for r in vote_counts(edges, d1).collect())
    assert a == b and len(a) == 8036
    assert candidates(vote_counts(edges, d1)).count() == 22


def test_connected_components_small_graphs(spark):
    from grovecount.operators.components import connected_components

    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 20), (5, 4)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.label for r in connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 10: 10, 11: 10, 12: 10}


def test_components_path_graph_long(spark):
    from grovecount.operators.components import connected_components

    n = 300  # a path needs many label-propagation rounds but few star rounds
    df = spark.range(0, n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(df)
    assert got.count() == n and got.where("label != 0").count() == 0


def test_hysteresis_long_weak_chain_over_many_tiles(spark):
    # a strong pixel at the start of a 60-pixel weak diagonal chain, plus a detached weak blob
    rows = [("c", 1, 1, 900)] + [("c", 1 + i, 1 + i, 450) for i in range(1, 60)] + [("c", 90, 5, 450)]
    thinned = spark.createDataFrame(rows, "image_id string, x int, y int, mag2 int")
    one = sorted((r.x, r.y) for r in grow_edges(thinned, 20, 25).collect())
    many = sorted((r.x, r.y) for r in grow_edges(thinned, 20, 25, tile=7).collect())
    assert one == many and len(many) == 60 and (90, 5) not in many


def test_hysteresis_tiles_do_not_matter_on_scenes(spark, scenes):
    from grovecount.operators.thinning import thin_pixels

    px, _ = scenes
    thinned = thin_pixels(px, 20)
    a = sorted(tuple(r) for r in grow_edges(thinned, 20, 25).collect())
    b = sorted(tuple(r) for r in grow_edges(thinned, 20, 25, tile=4).collect())
    assert a == b and len(a) == sum(v[0] for v in EXPECTED.values())


def test_thinning_tiles_do_not_matter_on_scenes(spark, scenes):
    from grovecount.operators.thinning import resolve, suppression_inputs

    px, _ = scenes
    cand = suppression_inputs(gradient(blur(px)), 20)
    a = sorted(tuple(r) for r in resolve(cand).collect())
    b = sorted(tuple(r) for r in resolve(cand, tile=2).collect())
    c = sorted(tuple(r) for r in resolve(cand, tile=9).collect())
    assert a == b == c and len(a) > 0


def test_thinning_long_chain(spark):
    from grovecount.operators.thinning import resolve

    # a 40-pixel chain: pixel i depends on pixel i-1 (stronger); pixel 0 is decided alive
    rows = [("c", 0, 0, 10000, False, False, -1, 0)]
    rows += [("c", i, 0, 10000 - i, False, True, i - 1, 0) for i in range(1, 40)]
    cand = spark.createDataFrame(rows, "image_id string, x int, y int, mag2 int, q_kills boolean, "
                                       "p_gt boolean, px int, py int")
    one = sorted(r.x for r in resolve(cand).collect())
    many = sorted(r.x for r in resolve(cand, tile=3).collect())
    single = sorted(r.x for r in resolve(cand, tile=1).collect())
    assert one == many == single == list(range(0, 40, 2))


@pytest.mark.parametrize("band", [1, 3, 7, 256])
def test_band_candidates_equal_dataframe_stencil(spark, band):
    from grovecount.operators.image_bands import band_candidates
    from grovecount.operators.thinning import suppression_inputs

    rng = np.random.default_rng(band)
    img = rng.integers(0, 256, size=(30, 40)).astype(np.int32)
    img[5:20, 10:25] = 250
    cols = ["x", "y", "mag2", "q_kills", "p_gt", "px", "py"]
    ref = suppression_inputs(gradient(blur(pixels_frame(spark, {"a": img}))), 20)
    ref = sorted(tuple(r) for r in ref.select(*cols).collect())
    parts = [pd.DataFrame(band_candidates(img, 20, y0, min(30, y0 + band))) for y0 in range(0, 30, band)]
    got = pd.concat(parts, ignore_index=True)[cols]
    got = sorted(tuple(v.item() if hasattr(v, "item") else v for v in row) for row in got.itertuples(index=False))
    assert got == ref and len(ref) > 100


def test_survey_nation_scenes_numbers(spark):
    """SURVEY §7.3: one 60x45 scene per nation row (25 images)."""
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from grovecount.sources.scenes import scene_dims, scene_pixels
    from grovecount.sources.tables import read_table

    nation = read_table(spark, SF_SMALL, "nation")
    px = scene_pixels(nation)
    assert px.agg(F.sum("v")).first()[0] == 475575
    g = gradient(blur(px)).where("mag2 > 0").agg(F.count("*"), F.sum("mag2")).first()
    assert tuple(g) == (4800, 46588120)
    det = detect_circles(px, scene_dims(nation))
    assert det.edges.count() == 1310
    assert tuple(det.votes.agg(F.count("*"), F.sum("votes")).first()) == (34250, 524000)
    assert det.candidates.count() == 1300
    per = sorted(tuple(r) for r in det.counts.groupBy("n").count().collect())
    assert per == [(1, 10), (6, 15)]


def test_gray_of_integer_mean(spark):
    from grovecount.functions.image import gray_of

    df = spark.createDataFrame([(30, 60, 91), (255, 255, 255), (0, 0, 2)], "r int, g int, b int")
    assert [r.v for r in df.select(gray_of("r", "g", "b").alias("v")).collect()] == [60, 255, 0]


def test_acceptance_of_detected_candidates_is_sequential(spark, scenes):
    px, dims = scenes
    cands = detect_circles(px, dims).candidates
    found = sorted(tuple(r) for r in accept_circles(cands).collect())
    assert found == greedy([tuple(r) for r in cands.select("image_id", "a", "b", "r", "votes").collect()])
    assert len(found) == 5


def test_image_too_small_for_any_radius_has_no_circles(spark):
    from grovecount.operators.hough import radius_ranges

    imgs = {"tiny": np.pad(np.full((4, 4), 255, dtype=np.int32), 2), "ok": disc_scene(120, 90, [(60, 45, 9)])}
    dims = dims_frame(spark, imgs)
    assert {r.image_id for r in radius_ranges(dims).collect()} == {"ok"}
    det = detect_circles(pixels_frame(spark, imgs), dims)
    assert sorted(tuple(r) for r in det.counts.collect()) == [("ok", 1), ("tiny", 0)]
