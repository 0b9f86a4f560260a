"""The scalar functions under SQL names, as SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Name, parameters, result, body.
FUNCTIONS = (
    ("range_xy", "x DOUBLE, y DOUBLE", "DOUBLE", "sqrt(x * x + y * y)"),
    ("lerp_at", "t0 DOUBLE, x0 DOUBLE, t1 DOUBLE, x1 DOUBLE, t DOUBLE", "DOUBLE", "CASE WHEN t1 <= t0 OR t <= t0 THEN x0 WHEN t >= t1 THEN x1 ELSE x0 + (t - t0) / (t1 - t0) * (x1 - x0) END"),
    ("sequence_key", "seq STRING", "STRING", "lpad(trim(seq), 6, '0')"),
    ("tier_of", "flag BOOLEAN", "STRING", "CASE WHEN coalesce(flag, true) THEN 'gold' ELSE 'silver' END"),
    (
        "in_ring",
        "px DOUBLE, py DOUBLE, ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>",
        "BOOLEAN",
        "size(ring) > 0 AND aggregate(zip_with(ring, concat(slice(ring, 2, size(ring)), slice(ring, 1, 1)), (a, b) -> "
        "coalesce((a.y > py) <> (b.y > py) AND px < (b.x - a.x) * (py - a.y) / (b.y - a.y + 1e-12) + a.x, false)), false, (odd, c) -> odd <> c)",
    ),
    # the part of the way from one heading to the other, along the shorter arc
    ("heading_between", "a DOUBLE, b DOUBLE, share DOUBLE", "DOUBLE", "a + least(greatest(share, 0D), 1D) * atan2(sin(b - a), cos(b - a))"),
    # how far a fisheye lens moves a point of the camera's frame from its axis, as a factor of x and y
    (
        "lens_scale",
        "x DOUBLE, y DOUBLE, z DOUBLE, k ARRAY<DOUBLE>",
        "DOUBLE",
        "CASE WHEN sqrt(x * x + y * y) < 1e-9 THEN 0D ELSE aggregate(transform(k, (c, i) -> c * power(atan2(sqrt(x * x + y * y), z), 3D + 2 * i)), atan2(sqrt(x * x + y * y), z), (a, c) -> a + c) "
        "/ greatest(sqrt(x * x + y * y), 1e-9) END",
    ),
)


def register(spark: SparkSession) -> None:
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
