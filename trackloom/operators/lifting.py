"""From image boxes to places in space: frustum points, the nearest slab, and its centre."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels a bucket is wide in the join of points and boxes.
BUCKET = 128.0


def in_frustum(points: DataFrame, boxes: DataFrame, kept_width: float = 0.6, low: float = 0.1, high: float = 0.9, bucket: float = BUCKET) -> DataFrame:
    """Pairs of a box (scan, box, x1, y1, x2, y2) and the points (scan, x, y, z, u, v) in its central part.

    An equi-join on the scan and on buckets of u; a point without a pixel is in no box.
    """
    side = (1 - kept_width) / 2
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cut = boxes.select("scan", "box", (F.col("x1") + side * width).alias("u1"), (F.col("x2") - side * width).alias("u2"), (F.col("y1") + low * height).alias("v1"), (F.col("y1") + high * height).alias("v2"))
    cut = cut.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("u1") / bucket), F.floor(F.col("u2") / bucket))))
    own = points.where("u is not null and v is not null").withColumn("bucket", F.floor(F.col("u") / bucket))
    inside = F.col("u").between(F.col("u1"), F.col("u2")) & F.col("v").between(F.col("v1"), F.col("v2"))
    return own.join(cut, ["scan", "bucket"]).where(inside).select("scan", "box", "x", "y", "z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2).alias("range"))


def lift(points: DataFrame, boxes: DataFrame, percentile: float = 0.15, slab: float = 1.5, least: int = 3, kept_width: float = 0.6, low: float = 0.1, high: float = 0.9, bucket: float = BUCKET) -> DataFrame:
    """For each box the median of the points in the slab behind its near surface (a low percentile of
    range); all points of the box where the slab has too few; null where the box has too few.

    Every box is kept. Pairs of a box and its points are never rows: boxes lie in square tiles of their image (by their low corner; a tile's
    side is the bucket doubled until the box is no longer), points go to the four tiles whose boxes can hold them, and a task takes one
    box of a tile after the other. So what is shuffled grows with points and boxes, and memory with the points of a tile.
    """
    side = (1 - kept_width) / 2
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    cut = boxes.select("scan", "box", (F.col("x1") + side * width).alias("u1"), (F.col("x2") - side * width).alias("u2"), (F.col("y1") + low * height).alias("v1"), (F.col("y1") + high * height).alias("v2"))
    some = F.coalesce(F.col("scan").isNotNull() & (F.col("u1") <= F.col("u2")) & (F.col("v1") <= F.col("v2")), F.lit(False))
    longest = F.greatest(F.col("u2") - F.col("u1"), F.col("v2") - F.col("v1"), F.lit(bucket / 2))
    level = F.greatest(F.lit(0), F.ceil(F.log2(1.001 * longest / bucket)).cast("int"))  # a little wider, for the rounding of logarithms
    tile = lambda c, size="level": F.floor(F.col(c) / (bucket * F.pow(F.lit(2.0), F.col(size))))
    keys = ["scan", "level", "tu", "tv"]
    placed = cut.where(some).withColumn("level", level).withColumns({"tu": tile("u1"), "tv": tile("v1")})
    own = points.where("scan is not null and u is not null and v is not null").select(F.col("scan").alias("of"), "x", "y", "z", "u", "v").crossJoin(F.broadcast(placed.select(F.col("level").alias("size")).distinct()))
    for name, c in (("pu", "u"), ("pv", "v")):
        own = own.withColumn(name, F.explode(F.array(tile(c, "size") - 1, tile(c, "size"))))
    used = placed.select(*[F.col(k).alias(f"box_{k}") for k in keys]).distinct()
    at = ["of", "size", "pu", "pv"]
    met = [F.col(a) == F.col(f"box_{k}") for a, k in zip(at, keys, strict=True)]
    own = own.join(used, met, "left_semi")
    kinds = [f"{c} {boxes.schema[c].dataType.simpleString()}" for c in ("scan", "box")]
    run = partial(_lifted, percentile=percentile, slab=slab, least=least)
    found = own.groupBy(*at).cogroup(placed.groupBy(*keys)).applyInArrow(run, ", ".join([*kinds, "x double, y double, z double, n_points long"]))
    return found.unionByName(cut.where(~some).select("scan", "box"), allowMissingColumns=True)


def _lifted(points: pa.Table, boxes: pa.Table, percentile: float, slab: float, least: int) -> pa.Table:
    """The boxes of one tile with their places. Places without a value count as points and are in no median."""
    points = points.sort_by("u")
    u, v, *at = (points.column(c).to_numpy() for c in ("u", "v", *"xyz"))
    known = [None if not points.column(c).null_count else points.column(c).is_valid().to_numpy() for c in "xyz"]
    reach = np.sqrt(at[0] ** 2 + at[1] ** 2)
    sure = None if known[0] is None and known[1] is None else np.logical_and(*[np.ones(len(u), dtype=bool) if k is None else k for k in known[:2]])
    u1, u2, v1, v2 = (boxes.column(c).to_numpy() for c in ("u1", "u2", "v1", "v2"))
    first, last = np.searchsorted(u, u1, side="left"), np.searchsorted(u, u2, side="right")
    place, n_points = [], []
    for a, b, lo, hi in zip(first.tolist(), last.tolist(), v1.tolist(), v2.tolist(), strict=True):
        own = a + np.flatnonzero((v[a:b] >= lo) & (v[a:b] <= hi))
        if len(own) < least:
            place.append([None] * 3)
            n_points.append(None)
            continue
        near = _quantile(reach, own, sure, percentile)
        if near is not None:
            close = own[reach[own] <= near + slab]
            own = close if len(close) >= least else own
        place.append([_quantile(c, own, k, 0.5) for c, k in zip(at, known, strict=True)])
        n_points.append(len(own))
    columns = [pa.array(c, pa.float64()) for c in zip(*place, strict=True)] if place else [pa.array([], pa.float64())] * 3
    return pa.table([boxes.column("scan"), boxes.column("box"), *columns, pa.array(n_points, pa.int64())], names=["scan", "box", *"xyz", "n_points"])


def _quantile(values: np.ndarray, rows: np.ndarray, known: np.ndarray | None, q: float) -> float | None:
    """The exact percentile as Spark's `percentile` interpolates it, of rows with a value."""
    own = values[rows if known is None else rows[known[rows]]]
    if not len(own):
        return None
    at = (len(own) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    own.partition([lo, hi])
    a, b = float(own[lo]), float(own[hi])
    return a if lo == hi or a == b else (hi - at) * a + (at - lo) * b


def pool(scans: DataFrame, lifted: DataFrame) -> DataFrame:
    """Candidates by scan; a scan without any stays, with an empty array, because a miss is information."""
    own = lifted.where("x is not null").groupBy("scan").agg(F.sort_array(F.collect_list(F.struct("box", "x", "y", "z", "n_points"))).alias("candidates"))
    empty = F.array().cast("array<struct<box:long,x:double,y:double,z:double,n_points:long>>")
    return scans.select("scan").join(own, "scan", "left").withColumn("candidates", F.coalesce("candidates", empty))


def points_in_box(x: Column, y: Column, z: Column, margin: float = 0.0, **box: Column) -> Column:
    """Whether a point is in an upright box without turn (centre cx, cy, cz; sizes length, width, height), borders included."""
    near = lambda p, c, size: F.abs(p - c) <= size / 2 + margin
    return near(x, box["cx"], box["length"]) & near(y, box["cy"], box["width"]) & near(z, box["cz"], box["height"])
