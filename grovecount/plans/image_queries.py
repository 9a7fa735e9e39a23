"""Registered circle-pipeline queries on synthetic scenes, and their SQL
oracles (DuckDB dialect).

Scene: one image per supplier row (the count grows with the scale factor):
either 60x45 with one disc shaped by the supplier's nation row (the
``scene_*`` / ``circle*`` / ``hough_*`` / ``crop_*`` queries), or a mixed scene of
its own size (``supplier_*``: faint and cut discs, noise, unequal channels), so
that every rule of the detector decides something; see ``sources/scenes.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovecount.functions.image import DEFAULT_HIGH, DEFAULT_LOW, DEFAULT_STEPS
from grovecount.operators.counts import keyed_sum
from grovecount.operators.crops import crop_boxes, crop_name, crop_pixels
from grovecount.operators.hough import circle_offsets, radii_in_use, radius_ranges, vote_counts
from grovecount.operators.hough_tiles import tile_candidates, tile_votes
from grovecount.operators.lookup import left_lookup_count
from grovecount.operators.overlap import accept_circles, circle_counts
from grovecount.operators.stencil import blur, gradient
from grovecount.operators.thinning import thin, thin_pixels
from grovecount.plans.detect import DetectParams, detect_circles_in_images, edge_pixels
from grovecount.plans.image_job import image_counts
from grovecount.sources.images import cut_boxes, cut_values, image_pixels
from grovecount.sources.scenes import (
    MIXED_BLUE,
    MIXED_DISCS,
    MIXED_GREEN,
    MIXED_HEIGHT,
    MIXED_WIDTH,
    SCENE_HEIGHT,
    SCENE_WIDTH,
    mixed_disc,
    mixed_level,
    nation_scenes,
    scene_dims,
    scene_images,
    scene_names,
    scene_pixels,
)
from grovecount.sources.tables import read_table


def _rows(spark, d, source):
    if source == "nation":
        # nation-shaped scenes, one per supplier: the work grows with the data
        return nation_scenes(read_table(spark, d, "supplier"), read_table(spark, d, "nation"))
    return read_table(spark, d, source)


def _pixels(spark, d, source="nation"):
    return scene_pixels(_rows(spark, d, source))


def _dims(spark, d, source="nation"):
    return scene_dims(_rows(spark, d, source))


def scene_gray(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    """O-13 as the job runs it: decoded image rows to gray pixels."""
    return image_pixels(scene_images(_rows(spark, d, source)), "image_id")


def scene_blur(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return blur(_pixels(spark, d, source))


def scene_gradient(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return gradient(blur(_pixels(spark, d, source)))


def scene_thin(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return thin_pixels(_pixels(spark, d, source), DEFAULT_LOW)


def scene_thin_snapshot(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return thin(gradient(blur(_pixels(spark, d, source))), DEFAULT_LOW, mode="snapshot")


def scene_edges(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return edge_pixels(_pixels(spark, d, source))


def circle_offsets_q(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return circle_offsets(radii_in_use(radius_ranges(_dims(spark, d, source))), DEFAULT_STEPS)


def hough_votes(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return vote_counts(scene_edges(spark, d, source), _dims(spark, d, source), by_tile=True)


def hough_tile_votes(spark: SparkSession, d: str, source: str = "supplier") -> DataFrame:
    """O-26, O-28 in dense accumulators per tile of centres."""
    return tile_votes(scene_edges(spark, d, source), _dims(spark, d, source))


def hough_candidates(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return tile_candidates(scene_edges(spark, d, source), _dims(spark, d, source))


def circles(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return accept_circles(hough_candidates(spark, d, source))


def circle_counts_q(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return circle_counts(circles(spark, d, source), _dims(spark, d, source))


def crop_boxes_q(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return crop_boxes(circles(spark, d, source), _dims(spark, d, source))


def crop_names_q(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    """O-20: crop names; every image is listed under two extensions of one stem."""
    stem = F.concat(F.lit("scene_"), F.col("image_id").cast("string"))
    both = circles(spark, d, source).select("image_id", "k", F.explode(F.array(
        F.concat(stem, F.lit(".png")), F.concat(stem, F.lit(".jpg")))).alias("image_name"))
    return both.select("image_id", "k", "image_name", crop_name().alias("crop_name"))


def crop_pixels_bytes(spark: SparkSession, d: str, source: str = "supplier") -> DataFrame:
    """O-35 from image bytes: boxes go to the images, pixels stay where they are."""
    images = scene_images(_rows(spark, d, source))
    return cut_boxes(images, crop_boxes_q(spark, d, source), "image_id")


def crop_bytes(spark: SparkSession, d: str, source: str = "supplier") -> DataFrame:
    """K-3: one value per crop, its gray bytes (as hex, which SQL can state)."""
    values = cut_values(scene_images(_rows(spark, d, source)), crop_boxes_q(spark, d, source), "image_id")
    return values.select("image_id", "k", "width", "height", F.hex("data").alias("pixels"))


def image_lookup(spark: SparkSession, d: str, source: str = "supplier") -> DataFrame:
    """O-22: the IMAGES job's lookup.  Every supplier is listed; every seventh has
    no image, every eleventh an unreadable one."""
    rows = _rows(spark, d, source)
    names = rows.select(F.concat(F.lit("scene_"), F.col("s_suppkey").cast("string"), F.lit(".png")).alias("image_name"))
    found = scene_images(rows).where("image_id % 7 <> 0")
    bad = F.col("image_id") % 11 == 0
    images = found.select(
        F.concat(F.lit("scene_"), F.col("image_id").cast("string"), F.lit(".png")).alias("image_name"),
        *[F.when(bad, -1).otherwise(F.col(c)).alias(c) for c in ("height", "width", "n_channels")],
        F.when(~bad, F.col("data")).alias("data"),
    )
    return image_counts(names, images).per_line


def crop_pixels_q(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    return crop_pixels(crop_boxes_q(spark, d, source), _pixels(spark, d, source))


def scene_type_counts(spark: SparkSession, d: str, source: str = "nation") -> DataFrame:
    """IMAGES job on the scenes: circles summed per type (region name)."""
    names = scene_names(_rows(spark, d, source), read_table(spark, d, "nation"), read_table(spark, d, "region"))
    typed = names.select("image_id", F.substring_index("image_name", "_", 1).alias("feature"))
    per_image = left_lookup_count(typed, circle_counts_q(spark, d, source), "image_id")
    return keyed_sum(per_image)


def scene_type_counts_bands(spark: SparkSession, d: str, source: str = "supplier") -> DataFrame:
    """IMAGES job through the image-file path: scenes rendered to image rows,
    banded stencil in the decoding task, then the Spark stages."""
    rows = _rows(spark, d, source)
    names = scene_names(rows, read_table(spark, d, "nation"), read_table(spark, d, "region"))
    typed = names.select("image_id", F.substring_index("image_name", "_", 1).alias("feature"))
    det = detect_circles_in_images(scene_images(rows), "image_id", DetectParams(stencil="bands"))
    return keyed_sum(left_lookup_count(typed, det.counts, "image_id"))


def _on(fn, source):
    def q(spark: SparkSession, d: str) -> DataFrame:
        return fn(spark, d, source)

    q.__name__ = f"{fn.__name__}_{source}"
    return q


_NATION = {
    "scene_gray": scene_gray,
    "scene_blur": scene_blur,
    "scene_gradient": scene_gradient,
    "scene_thin": scene_thin,
    "scene_thin_snapshot": scene_thin_snapshot,
    "scene_edges": scene_edges,
    "circle_offsets": circle_offsets_q,
    "hough_votes": hough_votes,
    "hough_candidates": hough_candidates,
    "circles": circles,
    "circle_counts": circle_counts_q,
    "crop_boxes": crop_boxes_q,
    "crop_pixels": crop_pixels_q,
    "scene_type_counts": scene_type_counts,
}
# Scenes that grow with the scale factor: one image per supplier row.
_SUPPLIER = {
    "supplier_scene_edges": scene_edges,
    "supplier_hough_votes": hough_tile_votes,
    "supplier_hough_candidates": hough_candidates,
    "supplier_circles": circles,
    "supplier_circle_counts": circle_counts_q,
    "supplier_crop_pixels": crop_pixels_q,
    "supplier_crop_pixels_bytes": crop_pixels_bytes,
    "supplier_crop_bytes": crop_bytes,
    "supplier_circle_offsets": circle_offsets_q,
    "supplier_crop_boxes": crop_boxes_q,
    "supplier_crop_names": crop_names_q,
    "supplier_scene_gray": scene_gray,
    "supplier_scene_thin": scene_thin,
    "supplier_image_lookup": image_lookup,
    "supplier_type_counts": scene_type_counts,
    "supplier_type_counts_bands": scene_type_counts_bands,
}

QUERIES = {name: _on(fn, "nation") for name, fn in _NATION.items()}
QUERIES.update({name: _on(fn, "supplier") for name, fn in _SUPPLIER.items()})

# ---------------------------------------------------------------------------
# SQL oracle.  Each stage is a CTE; a query selects from its last stage.


def _shift(c: str, w: str, k: int) -> str:
    if k == 0:
        return c
    fn = "lag" if k < 0 else "lead"
    parts = [f"{fn}({c}, {j}) OVER {w}" for j in range(abs(k), 0, -1)] + [c]
    return f"coalesce({', '.join(parts)})"


def _weighted(c: str, w: str) -> str:
    return " + ".join(f"{wk} * {_shift(c, w, k - 2)}" for k, wk in enumerate((1, 4, 6, 4, 1)))


_W, _H, _N = SCENE_WIDTH, SCENE_HEIGHT, SCENE_WIDTH * SCENE_HEIGHT
_LOW2, _HIGH2 = DEFAULT_LOW * DEFAULT_LOW, DEFAULT_HIGH * DEFAULT_HIGH
_WR = "(PARTITION BY image_id, y ORDER BY x)"
_WC = "(PARTITION BY image_id, x ORDER BY y)"
_ANGLE = "atan2(gy, gx)"

def _stages(source: str):
    if source == "nation":
        return [
            ("disc", """SELECT s_suppkey AS image_id, 20 + (n_nationkey * 20) // 25 AS cx,
                    15 + n_regionkey * 3 AS cy, 4 + n_regionkey % 3 AS rad
                   FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
            ("dims", f"SELECT image_id, {_W} AS width, {_H} AS height FROM disc"),
            ("px", f"""SELECT image_id, CAST(i % {_W} AS INTEGER) AS x, CAST(i // {_W} AS INTEGER) AS y,
                    CASE WHEN (i % {_W} - cx) * (i % {_W} - cx) + (i // {_W} - cy) * (i // {_W} - cy) <= rad * rad
                         THEN 255 ELSE 0 END AS v
                   FROM disc CROSS JOIN range(0, {_N}) t(i)"""),
            *_STAGES,
        ]
    discs = ", ".join(f"{e} AS {c}{j}" for j in range(MIXED_DISCS) for c, e in mixed_disc(j).items())
    return [
        ("keys", "SELECT s_suppkey AS s, CAST(s_nationkey AS BIGINT) AS n FROM supplier"),
        ("sized", f"""SELECT s, n, CAST({MIXED_WIDTH} AS INTEGER) AS width, CAST({MIXED_HEIGHT} AS INTEGER) AS height
                   FROM keys"""),
        ("dims", "SELECT s AS image_id, width, height FROM sized"),
        ("disc", f"SELECT *, {discs} FROM sized"),
        ("cell", "SELECT *, unnest(range(0, width * height)) AS i FROM disc"),
        ("lv", f"""SELECT s, x, y, {mixed_level()} AS v
                FROM (SELECT *, CAST(i % width AS INTEGER) AS x, CAST(i // width AS INTEGER) AS y FROM cell)"""),
        ("px", f"SELECT s AS image_id, x, y, CAST((v + {MIXED_GREEN} + {MIXED_BLUE}) // 3 AS INTEGER) AS v FROM lv"),
        *_STAGES,
    ]


_STAGES = [
    ("hb", f"SELECT image_id, x, y, {_weighted('v', _WR)} AS h FROM px"),
    ("bl", f"SELECT image_id, x, y, CAST(({_weighted('h', _WC)}) // 256 AS INTEGER) AS v FROM hb"),
    ("gyt", f"SELECT *, lead(v) OVER {_WC} - lag(v) OVER {_WC} AS gy FROM bl"),
    ("gxt", f"SELECT *, lead(v) OVER {_WR} - lag(v) OVER {_WR} AS gx FROM gyt"),
    ("gr", f"""SELECT image_id, x, y,
                CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN gx * gx + gy * gy ELSE 0 END AS mag2,
                CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN CAST(floor(
                    (CASE WHEN {_ANGLE} >= 0 THEN {_ANGLE} ELSE {_ANGLE} + pi() END) / (pi() / 4) + 0.5)
                  AS INTEGER) ELSE 0 END AS dir
               FROM gxt"""),
    ("nb1", f"SELECT *, lag(mag2) OVER {_WR} AS m_lc, lead(mag2) OVER {_WR} AS m_rc FROM gr"),
    ("nb", f"""SELECT *, lag(mag2) OVER {_WC} AS m_cu, lead(mag2) OVER {_WC} AS m_cd,
                lag(m_lc) OVER {_WC} AS m_lu, lead(m_lc) OVER {_WC} AS m_ld,
                lag(m_rc) OVER {_WC} AS m_ru, lead(m_rc) OVER {_WC} AS m_rd FROM nb1"""),
    ("e", f"""SELECT image_id, x, y, mag2,
                (CASE dir WHEN 1 THEN m_rd WHEN 2 THEN m_cd WHEN 3 THEN m_ru ELSE m_rc END) > mag2 AS q_kills,
                (CASE dir WHEN 1 THEN m_lu WHEN 2 THEN m_cu WHEN 3 THEN m_ld ELSE m_lc END) > mag2 AS p_gt,
                x + (CASE dir WHEN 2 THEN 0 ELSE -1 END) AS px,
                y + (CASE dir WHEN 1 THEN -1 WHEN 2 THEN -1 WHEN 3 THEN 1 ELSE 0 END) AS py
               FROM nb WHERE mag2 > {_LOW2}"""),
    ("st(image_id, x, y, killed)", """SELECT image_id, x, y, q_kills FROM e WHERE q_kills OR NOT p_gt
               UNION ALL
               SELECT e.image_id, e.x, e.y, NOT st.killed FROM e
               JOIN st ON e.image_id = st.image_id AND e.px = st.x AND e.py = st.y
               WHERE NOT e.q_kills AND e.p_gt"""),
    ("th", "SELECT e.image_id, e.x, e.y, e.mag2 FROM e JOIN st USING (image_id, x, y) WHERE NOT st.killed"),
    ("ed(image_id, x, y)", f"""SELECT image_id, x, y FROM th WHERE mag2 > {_HIGH2}
               UNION
               SELECT w.image_id, w.x, w.y FROM ed JOIN th w ON w.image_id = ed.image_id
                 AND w.x BETWEEN ed.x - 1 AND ed.x + 1 AND w.y BETWEEN ed.y - 1 AND ed.y + 1"""),
    ("rng", """SELECT image_id, greatest(1, least(width, height) // 15) AS r_min,
                greatest(width, height) // 10 AS r_max FROM dims"""),
    ("offs", f"""SELECT r, dx, dy, CAST(count(*) AS BIGINT) AS weight FROM (
                SELECT rr.r,
                  CAST(trunc(rr.r * cos(2 * pi() * s / {DEFAULT_STEPS})) AS INTEGER) AS dx,
                  CAST(trunc(rr.r * sin(2 * pi() * s / {DEFAULT_STEPS})) AS INTEGER) AS dy
                FROM (SELECT DISTINCT CAST(unnest(range(r_min, r_max + 1)) AS INTEGER) AS r FROM rng) rr
                CROSS JOIN range(0, {DEFAULT_STEPS}) t(s)) GROUP BY r, dx, dy"""),
    ("vt", """SELECT ed.image_id, ed.x - o.dx AS a, ed.y - o.dy AS b, o.r, CAST(sum(o.weight) AS BIGINT) AS votes
               FROM ed JOIN rng USING (image_id) JOIN offs o ON o.r BETWEEN rng.r_min AND rng.r_max
               GROUP BY ed.image_id, ed.x - o.dx, ed.y - o.dy, o.r"""),
    ("cand", f"SELECT * FROM vt WHERE CAST(votes AS DOUBLE) / {DEFAULT_STEPS} >= 0.4"),
    ("rk", """SELECT image_id, a, b, r, votes,
                row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, r, a, b) AS i FROM cand"""),
    ("gd(image_id, i, acc)", """SELECT DISTINCT image_id, CAST(0 AS BIGINT),
                  CAST([] AS STRUCT(a INTEGER, b INTEGER, r INTEGER, votes BIGINT)[]) FROM rk
               UNION ALL
               SELECT gd.image_id, gd.i + 1,
                 CASE WHEN len(list_filter(gd.acc, lambda q: (q.a - c.a) * (q.a - c.a)
                                 + (q.b - c.b) * (q.b - c.b) < q.r * q.r)) = 0
                      THEN list_append(gd.acc, {'a': c.a, 'b': c.b, 'r': c.r, 'votes': c.votes})
                      ELSE gd.acc END
               FROM gd JOIN rk c ON c.image_id = gd.image_id AND c.i = gd.i + 1"""),
    ("fin", "SELECT * FROM gd QUALIFY i = max(i) OVER (PARTITION BY image_id)"),
    ("circ", """SELECT image_id, CAST(k AS INTEGER) AS k, acc[k + 1].a AS a, acc[k + 1].b AS b,
                acc[k + 1].r AS r, acc[k + 1].votes AS votes
               FROM (SELECT image_id, acc, unnest(range(len(acc))) AS k FROM fin)"""),
    ("cnt", """SELECT dims.image_id, CAST(count(circ.k) AS BIGINT) AS n
               FROM dims LEFT JOIN circ USING (image_id) GROUP BY dims.image_id"""),
    ("box", """SELECT image_id, k, greatest(0, least(a - r, width)) AS x0, greatest(0, least(b - r, height)) AS y0,
                greatest(0, least(a + r, width)) AS x1, greatest(0, least(b + r, height)) AS y1
               FROM circ JOIN dims USING (image_id)"""),
]


def scene_sql(final: str, source: str = "nation") -> str:
    """All stages as CTEs, then the final SELECT (DuckDB skips unused CTEs)."""
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in _stages(source))
    return f"WITH RECURSIVE {ctes}\n{final}"


def _type_counts_sql(source: str) -> str:
    # type = region of the supplier's nation, for both scene geometries
    return scene_sql("""SELECT lower(r_name) AS feature, CAST(sum(coalesce(cnt.n, 0)) AS BIGINT) AS n
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN cnt ON cnt.image_id = s_suppkey GROUP BY 1""", source)


_FINAL = {
    "scene_gray": "SELECT image_id, x, y, v FROM px",
    "scene_blur": "SELECT image_id, x, y, v FROM bl",
    "scene_gradient": "SELECT image_id, x, y, mag2, dir FROM gr",
    "scene_thin": "SELECT image_id, x, y, mag2 FROM th",
    "scene_thin_snapshot": "SELECT image_id, x, y, mag2 FROM e WHERE NOT q_kills AND NOT p_gt",
    "scene_edges": "SELECT image_id, x, y FROM ed",
    "circle_offsets": "SELECT r, dx, dy, weight FROM offs",
    "hough_votes": "SELECT image_id, a, b, r, votes FROM vt",
    "hough_candidates": "SELECT image_id, a, b, r, votes FROM cand",
    "circles": "SELECT image_id, k, a, b, r, votes FROM circ",
    "circle_counts": "SELECT image_id, n FROM cnt",
    "crop_boxes": "SELECT image_id, k, x0, y0, x1, y1 FROM box",
    "crop_names": """SELECT image_id, k, 'scene_' || image_id || ext AS image_name,
        'scene_scene_' || image_id || ext || '_' || k || '.png' AS crop_name
        FROM circ CROSS JOIN (VALUES ('.png'), ('.jpg')) t(ext)""",
    "image_lookup": """SELECT 'scene_' || image_id || '.png' AS image_name, 'scene' AS feature,
        CAST(CASE WHEN image_id % 7 = 0 OR image_id % 11 = 0 THEN 0 ELSE n END AS BIGINT) AS n,
        CASE WHEN image_id % 7 = 0 THEN 'missing' WHEN image_id % 11 = 0 THEN 'unreadable' ELSE 'ok' END AS status
        FROM cnt""",
    "crop_bytes": """SELECT box.image_id, box.k, any_value(box.x1 - box.x0) AS width,
         any_value(box.y1 - box.y0) AS height, string_agg(printf('%02X', px.v), '' ORDER BY px.y, px.x) AS pixels
        FROM box JOIN px ON px.image_id = box.image_id AND px.x >= box.x0 AND px.x < box.x1
         AND px.y >= box.y0 AND px.y < box.y1 GROUP BY box.image_id, box.k""",
    "crop_pixels": """SELECT box.image_id, box.k, px.x, px.y, px.v FROM box
        JOIN px ON px.image_id = box.image_id AND px.x >= box.x0 AND px.x < box.x1
         AND px.y >= box.y0 AND px.y < box.y1""",
}

ORACLE = {name: scene_sql(_FINAL[name], "nation") for name in _NATION if name in _FINAL}
ORACLE["scene_type_counts"] = _type_counts_sql("nation")
for _name in _SUPPLIER:
    _base = _name.removeprefix("supplier_")
    if _base in ("type_counts", "type_counts_bands"):
        ORACLE[_name] = _type_counts_sql("supplier")
    else:
        ORACLE[_name] = scene_sql(_FINAL[_base if _base in _FINAL else _base.removesuffix("_bytes")], "supplier")
