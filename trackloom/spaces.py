"""Registered queries of geometry: poses, cameras, boxes, scans; see `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import LENS, query, rounded
from .functions import geometry as G
from .functions import registry
from .operators import surfaces
from .plans.adapters import POINTS_SQL, frames, points, FRAMES_SQL

# A pose of each row: turned by half its x, shifted by its coordinates in another order; and a second one.
POSE_SQL = "cos(x / 2) AS ac, sin(x / 2) AS as_, y AS a1, z AS a2, x AS a3, cos(y) AS bc, sin(y) AS bs, z AS b1, x AS b2, y AS b3"


def _poses():
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    return G.rigid(x / 2, y, z, x), G.rigid(y, z, x, y)


@query(f"""WITH {POINTS_SQL}, p AS (SELECT *, {POSE_SQL} FROM points), d AS (SELECT *, b1 - a1 AS d1, b2 - a2 AS d2, b3 - a3 AS d3 FROM p)
SELECT vec_id, round(ac * bc + as_ * bs, 6) AS turn_c, round(ac * bs - as_ * bc, 6) AS turn_s, round(ac * d1 + as_ * d2, 6) AS shift_x, round(-as_ * d1 + ac * d2, 6) AS shift_y, round(d3, 6) AS shift_z FROM d""")
def relative_poses(spark, sf_dir):
    """One pose seen from another: inverse, then product."""
    a, b = _poses()
    m = G.compose(G.inverse(a), b)
    names = {"turn_c": 0, "turn_s": 4, "shift_x": 3, "shift_y": 7, "shift_z": 11}
    return rounded(points(spark, sf_dir).withColumn("m", m).select("vec_id", *[F.element_at("m", i + 1).alias(n) for n, i in names.items()]))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT *, {POSE_SQL} FROM points), w AS (SELECT *, ac * x - as_ * y + a1 AS wx, as_ * x + ac * y + a2 AS wy, z + a3 AS wz FROM p)
SELECT vec_id, round(wx, 6) AS wx, round(wy, 6) AS wy, round(wz, 6) AS wz, round(x, 6) AS back_x, round(y, 6) AS back_y, round(z, 6) AS back_z, round(sqrt(wx * wx + wy * wy), 6) AS range_xy FROM w""")
def world_and_back(spark, sf_dir):
    """A point of the sensor in the world and back again: `transform` and `untransform`."""
    pose, _ = _poses()
    there = G.transform(pose, F.col("x"), F.col("y"), F.col("z"))
    rows = points(spark, sf_dir).withColumns({"pose": pose, **dict(zip(("wx", "wy", "wz"), there, strict=True))})
    back = G.untransform(F.col("pose"), F.col("wx"), F.col("wy"), F.col("wz"))
    return rounded(rows.select("vec_id", "wx", "wy", "wz", *[c.alias(n) for n, c in zip(("back_x", "back_y", "back_z"), back, strict=True)], G.range_xy(F.col("wx"), F.col("wy")).alias("range_xy")))


# The camera looks up from eight below: its depth is z + 8. Pixels as in `fisheye_project`.
CAMERA = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 8.0, 0.0, 0.0, 0.0, 1.0]


def lens_sql(x: str, y: str, z: str) -> tuple[str, str]:
    r, th = f"sqrt({x} * {x} + {y} * {y})", f"atan2(sqrt({x} * {x} + {y} * {y}), {z})"
    scale = f"(CASE WHEN {r} < 1e-9 THEN 0.0 ELSE {th} * (1.0 + {th} * {th} * (0.05 + {th} * {th} * (-0.01 + {th} * {th} * (0.002 + {th} * {th} * -0.0003)))) / greatest({r}, 1e-9) END)"
    return f"900.0 * {x} * {scale} + 960.0", f"910.0 * {y} * {scale} + 540.0"


_U, _V = lens_sql("qx", "qy", "qz")
PIXELS_SQL = f"""{POINTS_SQL}, p AS (SELECT *, {POSE_SQL} FROM points), s AS (SELECT *, ac * (x - a1) + as_ * (y - a2) AS qx, -as_ * (x - a1) + ac * (y - a2) AS qy, z - a3 + 8 AS qz FROM p),
f AS (SELECT vec_id, label, qz, {_U} AS u, {_V} AS v FROM s), pixels AS (SELECT *, qz > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1080 AS shown FROM f)"""


def _camera():
    return F.array(*map(F.lit, CAMERA))


def _pixels(spark, sf_dir):
    pose, _ = _poses()
    return surfaces.project(points(spark, sf_dir).withColumn("pose", pose), F.col("pose"), (0.0, 0.0, 8.0), LENS, 1920, 1080)


@query(f"WITH {PIXELS_SQL} SELECT vec_id, CASE WHEN shown THEN round(u, 5) END AS u, CASE WHEN shown THEN round(v, 5) END AS v, CASE WHEN shown THEN round(qz, 5) END AS depth FROM pixels")
def world_to_pixel(spark, sf_dir):
    """Aligned: a row for each point, null where the image does not show it."""
    return rounded(_pixels(spark, sf_dir).select("vec_id", *[F.when(F.col("shown"), F.col(c)).alias(c) for c in ("u", "v", "depth")]), 5)


@query(f"WITH {PIXELS_SQL} SELECT label, count(*) AS n, round(min(qz), 5) AS nearest, round(max(u), 5) AS rightmost FROM pixels WHERE shown GROUP BY label")
def packed_pixels(spark, sf_dir):
    """Packed: the points that the image shows."""
    own = _pixels(spark, sf_dir).groupBy("label").agg(F.count_if("shown").alias("n"), F.min(F.when(F.col("shown"), F.col("depth"))).alias("nearest"), F.max(F.when(F.col("shown"), F.col("u"))).alias("rightmost"))
    return rounded(own.where("n > 0"), 5)


_BU, _BV = lens_sql("kx", "ky", "kz")


@query(f"""WITH {POINTS_SQL}, c AS (SELECT vec_id, x + {{a}}.dx AS kx, y + {{a}}.dy AS ky, z + 8 + {{a}}.h AS kz FROM points,
  LATERAL (SELECT l * 2.0 * cos(z) - w * 1.0 * sin(z) AS dx, l * 2.0 * sin(z) + w * 1.0 * cos(z) AS dy, hh * 0.5 AS h FROM (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) q(l, w), (VALUES (1), (-1)) t(hh)) {{a}}),
f AS (SELECT vec_id, kz, {_BU} AS u, {_BV} AS v FROM c),
g AS (SELECT vec_id, count(*) AS n, min(u) AS x1, min(v) AS y1, max(u) AS x2, max(v) AS y2 FROM f WHERE kz > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1080 GROUP BY vec_id)
SELECT p.vec_id, CAST(coalesce(n, 0) AS INT) AS n_visible, {", ".join(f"round(greatest(0, least({c}, {m})), 1) AS {c}" for c, m in (("x1", 1919), ("y1", 1079), ("x2", 1919), ("y2", 1079)))} FROM points p LEFT JOIN g USING (vec_id)""".replace("{a}", "o"))
def box_in_image(spark, sf_dir):
    box = G.corners(F.col("x"), F.col("y"), F.col("z"), F.lit(4.0), F.lit(2.0), F.lit(1.0), F.col("z"))
    return surfaces.boxes_in_image(points(spark, sf_dir).select("vec_id", box.alias("corners")), "vec_id", _camera(), LENS, 1920, 1080)


_HEADING = [(1, 1), (1, -1), (-1, -1), (-1, 1)]


@query(f"""WITH {POINTS_SQL}, h AS (SELECT *, CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE x / sqrt(x * x + y * y) END AS c, CASE WHEN vec_id % 10 = 0 THEN 0.0 ELSE y / sqrt(x * x + y * y) END AS s FROM points),
k AS (SELECT vec_id, unnest([{", ".join(f"{{'place': {i}, 'x': x + {a * 2.0} * c - {b * 1.0} * s, 'y': y + {a * 2.0} * s + {b * 1.0} * c, 'z': z + {0.75 if i > 3 else -0.75}}}" for i, (a, b) in enumerate(_HEADING * 2))}]) AS p FROM h)
SELECT vec_id, p.place AS place, round(p.x, 6) AS x, round(p.y, 6) AS y, round(p.z, 6) AS z FROM k""")
def heading_corners(spark, sf_dir):
    still = F.col("vec_id") % 10 == 0
    hx, hy = F.when(still, 0.0).otherwise(F.col("x")), F.when(still, 0.0).otherwise(F.col("y"))
    box = G.heading_corners(F.col("x"), F.col("y"), F.col("z"), F.lit(4.0), F.lit(2.0), F.lit(1.5), hx, hy)
    return rounded(points(spark, sf_dir).select("vec_id", F.posexplode(box).alias("place", "p")).select("vec_id", "place", "p.x", "p.y", "p.z"))


@query(f"""WITH {POINTS_SQL}, q AS (SELECT *, cos(z / 2) AS w, sin(z / 2) AS k FROM points), d AS (SELECT *, x - 1 AS dx, y + 0.5 AS dy, z - 0.25 AS dz, 1 - 2 * k * k AS c, 2 * w * k AS s FROM q)
SELECT label, count(*) AS n, count(*) FILTER (abs(c * dx + s * dy) <= 2.0 AND abs(-s * dx + c * dy) <= 1.0 AND abs(dz) <= 1.5) AS n_inside FROM d GROUP BY label""")
def points_in_turned_box(spark, sf_dir):
    """Points in a box that is turned about the vertical axis, by its quaternion."""
    q = (F.cos(F.col("z") / 2), F.lit(0.0), F.lit(0.0), F.sin(F.col("z") / 2))
    hit = G.in_turned_box(F.col("x"), F.col("y"), F.col("z"), (F.lit(1.0), F.lit(-0.5), F.lit(0.25)), (F.lit(4.0), F.lit(2.0), F.lit(3.0)), q)
    return points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_inside"))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT label, CASE WHEN label % 3 = 0 THEN x ELSE abs(x) * 250 END AS x, CASE WHEN label % 3 = 0 THEN y WHEN label % 3 = 1 THEN abs(y) * 200 ELSE -abs(y) * 900 END AS y FROM points),
r AS (SELECT label, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2 FROM s GROUP BY label)
SELECT label, CASE WHEN x1 >= 0 AND y1 >= 0 AND x2 <= 19200 AND y2 <= 10800 AND (x2 > 200 OR y2 > 200) THEN 'pixel' WHEN greatest(abs(x1), abs(x2)) <= 200 AND greatest(abs(y1), abs(y2)) <= 200 THEN 'metric' END AS space FROM r""")
def polygon_spaces(spark, sf_dir):
    kind = F.col("label") % 3
    rows = points(spark, sf_dir).select("label", F.when(kind == 0, F.col("x")).otherwise(F.abs("x") * 250).alias("x"), F.when(kind == 0, F.col("y")).when(kind == 1, F.abs("y") * 200).otherwise(-F.abs("y") * 900).alias("y"))
    ends = rows.groupBy("label").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))
    return ends.select("label", G.polygon_space(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 19_200, 10_800).alias("space"))


# ---- scans --------------------------------------------------------------------------------------


@query(f"""WITH {POINTS_SQL}, p AS (SELECT *, {POSE_SQL} FROM points), w AS (SELECT *, ac * x - as_ * y + a1 AS wx, as_ * x + ac * y + a2 AS wy, z + a3 AS wz FROM p)
SELECT vec_id, round(bc * (wx - b1) + bs * (wy - b2), 6) AS x, round(-bs * (wx - b1) + bc * (wy - b2), 6) AS y, round(wz - b3, 6) AS z FROM w""")
def compensated_scan(spark, sf_dir):
    a, b = _poses()
    rows = points(spark, sf_dir).withColumns({"a": a, "b": b})
    return rounded(surfaces.compensated(rows, F.col("a"), F.col("b")).select("vec_id", "x", "y", "z"))


RING = ((200.0, 100.0), (1700.0, 150.0), (1500.0, 1000.0), (900.0, 500.0), (300.0, 950.0))
_RING_SQL = " + ".join(f"(({ay} > v) <> ({by} > v) AND u < ({bx - ax}::DOUBLE * (v - {ay}::DOUBLE) / {by - ay + 1e-12!r}::DOUBLE + {ax}::DOUBLE))::INT" for (ax, ay), (bx, by) in zip(RING, [*RING[1:], RING[0]], strict=True))
_SU, _SV = lens_sql("x", "y", "(z + 8)")


@query(f"""WITH {POINTS_SQL}, f AS (SELECT vec_id, label, x, y, z, {_SU} AS u, {_SV} AS v FROM points),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place, ceil(count(*) OVER (PARTITION BY label) / 10) AS step FROM f WHERE z + 8 > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1080 AND ({_RING_SQL}) % 2 = 1)
SELECT label, vec_id, round(x - 1, 6) AS x, round(y + 2, 6) AS y, round(z + 3, 6) AS z FROM r WHERE place % step = 0""")
def road_surface(spark, sf_dir):
    """Points on the road of each scan, at most ten of each by stride."""
    world = G.rigid(F.lit(0.0), F.lit(-1.0), F.lit(2.0), F.lit(3.0))
    found = surfaces.road_surface(points(spark, sf_dir), _camera(), world, LENS, RING, 1920, 1080, "label", ["vec_id"], 10)
    return rounded(found)


@query(f"""WITH {POINTS_SQL}, b AS (SELECT label, vec_id, x, y, 0.05 + abs(z) / 40 AS h FROM points), h AS (SELECT p.label, p.vec_id, b.vec_id AS box, 4 * b.h * b.h AS area FROM points p JOIN b ON b.label = p.label AND p.x BETWEEN b.x - b.h AND b.x + b.h AND p.y + 0.01 BETWEEN b.y - b.h AND b.y + b.h),
m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(area, 12), box) = 1)
SELECT p.label AS scan, p.vec_id AS pixel, m.box, round(m.area, 6) AS area FROM points p LEFT JOIN m USING (vec_id)""")
def smallest_box(spark, sf_dir):
    rows, h = points(spark, sf_dir), 0.05 + F.abs("z") / 40
    boxes = rows.select(F.col("label").alias("scan"), F.col("vec_id").alias("box"), (F.col("x") - h).alias("x1"), (F.col("y") - h).alias("y1"), (F.col("x") + h).alias("x2"), (F.col("y") + h).alias("y2"))
    return rounded(surfaces.smallest_box(rows.select(F.col("label").alias("scan"), F.col("vec_id").alias("pixel"), F.col("x").alias("u"), (F.col("y") + 0.01).alias("v")), boxes, 0.25))


@query(f"""WITH {POINTS_SQL}, l AS (SELECT *, ln(1 + abs(x)) AS g FROM points), e AS (SELECT label, quantile_cont(g, 0.02) AS lo, quantile_cont(g, 0.98) AS hi FROM l GROUP BY label)
SELECT vec_id, round(greatest(0, least(1, (g - lo) / (hi - lo))), 6) AS stretched FROM l JOIN e USING (label)""")
def intensity_stretch(spark, sf_dir):
    return rounded(surfaces.stretched(points(spark, sf_dir), F.abs("x"), "label").select("vec_id", "stretched"))


@query(f"""WITH {FRAMES_SQL}, m AS (SELECT track, (min(t) + max(t)) / 2 AS moment FROM frames GROUP BY track),
n AS (SELECT m.track, moment, t, frame, abs(t - moment) AS gap FROM m LEFT JOIN (SELECT * FROM frames WHERE kind = 'view') f USING (track) QUALIFY row_number() OVER (PARTITION BY m.track ORDER BY gap, t, frame) = 1)
SELECT track, round(moment, 6) AS moment, round(t, 6) AS match_t, frame AS name, round(gap, 6) AS gap FROM n""")
def nearest_scan(spark, sf_dir):
    """The scan nearest to each track's middle, with its gap: no tolerance."""
    rows = frames(spark, sf_dir)
    moments = rows.groupBy("track").agg(((F.min("t") + F.max("t")) / 2).alias("moment"))
    return rounded(surfaces.nearest_record(moments, rows.where("kind = 'view'").select("track", "t", F.col("frame").alias("name")), "track"))


_LU, _LV = lens_sql("x", '"y"', "(z + 8)")


@query(f"""WITH {POINTS_SQL}, o AS (SELECT *, lag(x) OVER w AS was_x, lag(vec_id) OVER w AS was FROM points WINDOW w AS (PARTITION BY label, vec_id // 50 ORDER BY vec_id))
SELECT vec_id, round({_LU}, 5) AS u, round({_LV}, 5) AS v, round(sqrt(x * x + "y" * "y"), 6) AS range_xy, round(x / 4 + 0.25 * atan2(sin("y" / 4 - x / 4), cos("y" / 4 - x / 4)), 6) AS heading,
  round(CASE WHEN was IS NOT NULL THEN was_x + 0.5 * (x - was_x) END, 6) AS halfway FROM o""")
def sql_functions(spark, sf_dir):
    """The registered functions as a SQL user calls them: pixels, ranges, headings a quarter of the way, and places between neighbours of a label (among fifty ids)."""
    registry.register(spark)
    lens = f"lens_scale(x, y, z + 8, array({', '.join(f'{c}D' for c in LENS['k'])}))"
    fx, fy, cx, cy = (LENS[c] for c in ("fx", "fy", "cx", "cy"))
    return spark.sql(
        f"""SELECT vec_id, round({fx}D * x * {lens} + {cx}D, 5) AS u, round({fy}D * y * {lens} + {cy}D, 5) AS v, round(range_xy(x, y), 6) AS range_xy, round(heading_between(x / 4, y / 4, 0.25), 6) AS heading,
          round(lerp_at(was, was_x, vec_id, x, (was + vec_id) / 2), 6) AS halfway FROM (SELECT *, lag(x) OVER w AS was_x, lag(vec_id) OVER w AS was FROM {{points}} WINDOW w AS (PARTITION BY label, vec_id DIV 50 ORDER BY vec_id))""",
        points=points(spark, sf_dir),
    )
