import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import geometry as G
from trackloom.functions import registry
from trackloom.operators import lifting, poses, spatial

SQUARE = ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))


def test_point_in_polygon(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (5.0, 2.0), (None, 2.0)], "x double, y double")
    rows = rows.withColumn("ring", F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in SQUARE]))
    fixed = [r[0] for r in rows.select(G.inside(F.col("x"), F.col("y"), SQUARE)).collect()]
    column = [r[0] for r in rows.select(G.inside_any(F.col("x"), F.col("y"), F.array("ring"))).collect()]
    assert fixed == column == [True, False, False]


@pytest.mark.parametrize(("yaw", "want"), [(0.0, [(2, 1), (2, -1), (-2, 1), (-2, -1)]), (math.pi / 2, [(-1, 2), (1, 2), (-1, -2), (1, -2)])])
def test_corners(spark, yaw, want):
    c = G.corners(*[F.lit(v) for v in (0.0, 0.0, 0.0, 4.0, 2.0, 1.0, yaw)])
    got = spark.range(1).select(c.alias("c")).first()["c"]
    assert [(p["x"], p["y"]) for p in got[:4]] == [pytest.approx(w, abs=1e-9) for w in want]
    assert [p["z"] for p in got] == [0.5] * 4 + [-0.5] * 4


def test_fisheye(spark):
    u = lambda x, z: G.fisheye(F.lit(x), F.lit(0.0), F.lit(z), (0.0, 0.0, 0.0, 0.0), 100.0, 100.0, 50.0, 50.0)[0]
    row = spark.range(1).select(u(1.0, 1.0).alias("a"), u(0.0, 5.0).alias("b")).first()
    assert row["a"] == pytest.approx(50 + 100 * math.pi / 4) and row["b"] == 50


def test_pose_and_back(spark):
    pose = F.array(*[F.lit(v) for v in (0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, 6.0, 0.0, 0.0, 1.0, 7.0, 0.0, 0.0, 0.0, 1.0)])
    there = G.transform(pose, F.lit(1.0), F.lit(2.0), F.lit(3.0))
    back = G.untransform(pose, *there)
    row = spark.range(1).select(*[c.alias(f"t{i}") for i, c in enumerate(there)], *[c.alias(f"b{i}") for i, c in enumerate(back)]).first()
    assert tuple(row) == pytest.approx((3, 7, 10, 1, 2, 3))


def test_radius_keeps_only_what_is_farther(spark):
    points = spark.createDataFrame([(1, 0, 1.5, 0.0), (2, 0, 1.6, 0.0)], "key long, scan long, x double, y double")
    claim = spark.createDataFrame([(9, 0, 0.0, 0.0)], "other long, scan long, ox double, oy double")
    assert [r["key"] for r in spatial.unclaimed(points, claim, 1.5, ["scan"]).collect()] == [2]


def test_nearest_distance_near_and_far(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 500.0, 0.0), (3, 1, 0.0, 0.0)], "key long, scan long, x double, y double")
    surface = spark.createDataFrame([(1, 0, 3.0, 4.0), (2, 0, 0.0, 90.0), (3, 0, 100.0, 0.0)], "other long, scan long, ox double, oy double")
    got = {r["key"]: r["distance"] for r in spatial.nearest_distance(points, surface, 1.0, ["scan"]).collect()}
    assert got == {1: 5.0, 2: 400.0, 3: None}


def test_key_member_ties_by_id(spark):
    rows = spark.createDataFrame([(0, 7, 1.0), (0, 3, 1.0), (0, 9, 2.0)], "seq long, track long, d double")
    assert spatial.key_member(rows, F.col("d")).first()["track"] == 3


BOX = "scan long, box long, x1 double, y1 double, x2 double, y2 double"
POINT = "scan long, x double, y double, z double, u double, v double"


def test_frustum_keeps_the_middle_of_a_box(spark):
    edge = [(20.0, 10.0), (80.0, 90.0), (19.0, 50.0), (81.0, 50.0), (50.0, 9.0), (50.0, 91.0), (None, 50.0)]
    points = spark.createDataFrame([(1, 1.0, 0.0, 0.0, u, v) for u, v in edge], POINT)
    boxes = spark.createDataFrame([(1, 7, 0.0, 0.0, 100.0, 100.0)], BOX)
    assert lifting.in_frustum(points, boxes, bucket=16.0).count() == 2
    assert lifting.lift(points, boxes).first()["x"] is None  # two points are too few
    assert lifting.pool(boxes.union(spark.createDataFrame([(2, 8, 0.0, 0.0, 1.0, 1.0)], BOX)).select("scan").distinct(), lifting.lift(points, boxes)).where("size(candidates) = 0").count() == 2


def test_lift_takes_the_near_slab(spark):
    rows = [(1, 10.0 + i / 10, 0.0, 1.0, 50.0, 50.0) for i in range(10)] + [(1, 40.0, 0.0, 1.0, 50.0, 50.0)] * 4
    got = lifting.lift(spark.createDataFrame(rows, POINT), spark.createDataFrame([(1, 7, 0.0, 0.0, 100.0, 100.0)], BOX)).first()
    assert got["x"] == pytest.approx(10.45) and got["n_points"] == 10


def test_lift_of_many_sizes_equals_pairs_and_shuffles_none(spark):
    """Boxes of 5 to 900 pixels on and across the tiles' edges, and places without a value, against the pairs of `in_frustum`."""
    rng = np.random.default_rng(3)
    rows = [(int(i % 2), *[None if rng.random() < 0.1 else float(a) for a in rng.normal(0, 3, 3)], *[float(a) for a in rng.integers(-600, 600, 2)]) for i in range(600)]
    corners = [(int(i % 2), i, *[float(a) for a in rng.integers(-600, 500, 2)], float(rng.choice([5, 128, 256, 900]))) for i in range(60)]
    points = spark.createDataFrame(rows, POINT)
    boxes = spark.createDataFrame([(s, i, a, b, a + n, b + n) for s, i, a, b, n in corners] + [(0, 98, None, 0.0, 1.0, 1.0), (None, 99, 0.0, 0.0, 9.0, 9.0)], BOX)
    want: dict = {}
    for r in lifting.in_frustum(points, boxes).collect():
        want.setdefault((r["scan"], r["box"]), []).append(r)
    found = lifting.lift(points, boxes)
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString()  # no aggregate over pairs
    got = {(r["scan"], r["box"]): r for r in found.collect()}
    assert len(got) == 62 and (None, 99) in got and sum(r["x"] is not None for r in got.values()) > 20
    for key, r in got.items():
        own = want.get(key, [])
        if len(own) < 3:
            assert r["x"] is None and r["n_points"] is None
            continue
        near = np.quantile([p["range"] for p in own if p["range"] is not None], 0.15)
        close = [p for p in own if p["range"] is not None and p["range"] <= near + 1.5]
        own = close if len(close) >= 3 else own
        assert r["n_points"] == len(own) and [r[c] for c in "xyz"] == [pytest.approx(float(np.median([p[c] for p in own if p[c] is not None]))) for c in "xyz"]


def test_points_in_box(spark):
    one = [F.lit(v) for v in (0.0, 0.0, 0.0, 4.0, 2.0, 1.0)]
    box = dict(zip(("cx", "cy", "cz", "length", "width", "height"), one, strict=True))
    inside = lifting.points_in_box(F.col("x"), F.lit(1.0), F.lit(0.5), **box)
    assert [r[0] for r in spark.createDataFrame([(2.0,), (2.1,)], "x double").select(inside).collect()] == [True, False]


def _pose(angle, x):
    c, s = math.cos(angle), math.sin(angle)
    return [c, -s, 0.0, x, s, c, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_poses_between_neighbours(spark):
    known = spark.createDataFrame([("a", 0.0, _pose(0.0, 0.0)), ("a", 2.0, _pose(math.pi / 2, 4.0))], "sequence_id string, ts double, pose array<double>")
    asked = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 1.0, 2.0, 9.0)] + [("b", 0.0)], "sequence_id string, t double")
    got = {r["t"]: r["pose"] for r in poses.poses_at(asked, known).where("sequence_id = 'a'").collect()}
    want = {-1.0: (0, 0), 0.0: (0, 0), 1.0: (math.pi / 4, 2), 2.0: (math.pi / 2, 4), 9.0: (math.pi / 2, 4)}
    for t, (angle, x) in want.items():
        assert got[t] == pytest.approx(_pose(angle, x), abs=1e-9)
    assert poses.poses_at(asked, known).where("sequence_id = 'b'").count() == 0


def test_turns_round_trip():
    q = np.random.default_rng(1).normal(size=(50, 4))
    r = poses.quaternion_to_rotation(q)
    assert np.allclose(poses.quaternion_to_rotation(poses.rotation_to_quaternion(r)), r)


def test_sql_functions(spark):
    registry.register(spark)
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D))"
    row = spark.sql(f"SELECT in_ring(1, 2, {ring}) a, in_ring(5, 2, {ring}) b, lerp_at(0, 0, 2, 10, 1) c, lerp_at(0, 0, 2, 10, 5) d, range_xy(3, 4) e, sequence_key(' 7 ') f, tier_of(NULL) g").first()
    assert tuple(row) == (True, False, 5.0, 10.0, 5.0, "000007", "gold")


def test_lens_and_heading_in_sql(spark):
    """The SQL functions against the column functions; a point on the axis, and headings over the shorter arc."""
    registry.register(spark)
    k = [0.05, -0.01, 0.002, -0.0003]
    rows = spark.createDataFrame([(0.0, 0.0, 3.0), (1.0, -2.0, 3.0), (5.0, 4.0, -1.0), (1e-12, 0.0, 1.0)], "x double, y double, z double")
    u, v = G.fisheye(F.col("x"), F.col("y"), F.col("z"), k, 900.0, 910.0, 960.0, 540.0)
    scale = f"lens_scale(x, y, z, array({', '.join(f'{c}D' for c in k)}))"
    for r in rows.select(u.alias("u"), v.alias("v"), F.expr(f"900 * x * {scale} + 960").alias("su"), F.expr(f"910 * y * {scale} + 540").alias("sv")).collect():
        assert (r["su"], r["sv"]) == (pytest.approx(r["u"], rel=1e-12), pytest.approx(r["v"], rel=1e-12))
    got = spark.sql("SELECT heading_between(3, -3, 0.5) a, heading_between(1, 2, 0.25) b, heading_between(1, 2, 7) c").first()
    assert (got["a"], got["b"], got["c"]) == (pytest.approx(math.pi), 1.25, 2.0)
