"""Scans as surfaces: the scan at a keyframe, motion compensation, road points, sampling and stretching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..session import written


def nearest_record(moments: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """For each key's moment (key, moment) the record (key, t, name) nearest in time, the earlier of equals, with its gap; nulls where there is none."""
    both = moments.join(records, key, "left").withColumn("gap", F.abs(F.col("t") - F.col("moment")))
    best = F.min_by(F.struct("t", "name", "gap"), F.struct("gap", "t", "name"))
    return both.groupBy(key).agg(F.first("moment").alias("moment"), best.alias("b")).select(key, "moment", F.col("b.t").alias("match_t"), F.col("b.name").alias("name"), F.col("b.gap").alias("gap"))


def compensated(points: DataFrame, at_scan: Column, at_key: Column) -> DataFrame:
    """Points (x, y, z) of a scan moved into the sensor's frame at the keyframe; both poses are world <- sensor."""
    x, y, z = G.transform(G.compose(G.inverse(at_key), at_scan), F.col("x"), F.col("y"), F.col("z"))
    return points.withColumns({"x": x, "y": y, "z": z})


def project(points: DataFrame, world: Column, shift: tuple[float, float, float], lens: dict, width: int, height: int) -> DataFrame:
    """World points (x, y, z) with u, v, depth in the camera of a sensor (pose world <- sensor; the camera looks along the sensor's z from
    `shift` behind) and `shown`. Step by step, so that each step's columns are made once."""
    own = G.untransform(world, F.col("x"), F.col("y"), F.col("z"))
    placed = points.withColumns({name: c + s for name, c, s in zip(("px", "py", "depth"), own, shift, strict=True)})
    u, v = G.fisheye(F.col("px"), F.col("py"), F.col("depth"), **lens)
    seen = placed.withColumns({"u": u, "v": v})
    return seen.withColumn("shown", G.visible(F.col("u"), F.col("v"), F.col("depth"), width, height)).drop("px", "py")


def pixels(points: DataFrame, camera: Column, lens: dict, width: int, height: int) -> DataFrame:
    """Points (x, y, z) with u, v, depth through a camera <- point transform, and `shown`.

    Two written steps: a filter or an aggregate on the pixel would otherwise write the camera's formula out once for each use."""
    placed = written(points.withColumns(dict(zip(("px", "py", "depth"), G.transform(camera, F.col("x"), F.col("y"), F.col("z")), strict=True))), "camera-points")
    u, v = G.fisheye(F.col("px"), F.col("py"), F.col("depth"), **lens)
    seen = written(placed.withColumns({"u": u, "v": v}).drop("px", "py"), "pixels")
    return seen.withColumn("shown", G.visible(F.col("u"), F.col("v"), F.col("depth"), width, height))


def boxes_in_image(boxes: DataFrame, key: str, camera: Column, lens: dict, width: int, height: int) -> DataFrame:
    """For each box (key, corners: array of points) n_visible and the range x1, y1, x2, y2 in tenths of pixels of the corners that the image shows, clipped
    to it; null where it shows none. Corners are rows, so each is projected once."""
    corners = boxes.select(key, F.explode("corners").alias("c")).select(key, "c.x", "c.y", "c.z")
    seen = pixels(corners, camera, lens, width, height).where("shown").groupBy(key)
    clipped = lambda c, most: F.round(F.greatest(F.lit(0.0), F.least(c, F.lit(float(most - 1)))), 1)
    own = seen.agg(F.count("*").cast("int").alias("n_visible"), clipped(F.min("u"), width).alias("x1"), clipped(F.min("v"), height).alias("y1"), clipped(F.max("u"), width).alias("x2"), clipped(F.max("v"), height).alias("y2"))
    return boxes.select(key).join(own, key, "left").withColumn("n_visible", F.coalesce("n_visible", F.lit(0)))


def stride_sample(points: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """Every k-th point of a key in order, with the smallest k that leaves at most `cap`: a sampling operator."""
    own = Window.partitionBy(key)
    step = F.greatest(F.ceil(F.count("*").over(own) / F.lit(cap)), F.lit(1))
    rows = points.withColumns({"_step": step, "_place": F.row_number().over(own.orderBy(*order)) - 1})
    return rows.where(F.col("_place") % F.col("_step") == 0).drop("_step", "_place")


def seeded_sample(rows: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """`n` rows without replacement, the same for a seed whatever the partitions: those of smallest hashes; a sampling operator."""
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def road_surface(points: DataFrame, camera: Column, world: Column, lens: dict, ring, width: int, height: int, key: str, order: list[str], cap: int = 60_000) -> DataFrame:
    """Points whose pixel falls into the road polygon, thinned by stride, in the world's frame: key, order columns, x, y, z."""
    seen = pixels(points, camera, lens, width, height)
    on_road = seen.where(F.col("shown") & G.inside(F.col("u"), F.col("v"), ring)).drop("u", "v", "depth", "shown")
    x, y, z = G.transform(world, F.col("x"), F.col("y"), F.col("z"))
    return stride_sample(on_road, key, order, cap).select(key, *order, x.alias("x"), y.alias("y"), z.alias("z"))


def smallest_box(pixels: DataFrame, boxes: DataFrame, bucket: float = 128.0) -> DataFrame:
    """For each pixel (scan, pixel, u, v) the box (scan, box, x1, y1, x2, y2) of smallest area that holds it, the smaller id of equals; none: null.

    An equi-join on the scan and on buckets of u.
    """
    cut = boxes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("x1") / bucket), F.floor(F.col("x2") / bucket))))
    own = pixels.withColumn("bucket", F.floor(F.col("u") / bucket))
    area = G.box_area(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    held = own.join(cut, ["scan", "bucket"]).where(F.col("u").between(F.col("x1"), F.col("x2")) & F.col("v").between(F.col("y1"), F.col("y2")))
    best = held.groupBy("scan", "pixel").agg(F.min(F.struct(area.alias("area"), "box")).alias("b")).select("scan", "pixel", "b.box", "b.area")
    return pixels.select("scan", "pixel").join(best, ["scan", "pixel"], "left")


def stretched(points: DataFrame, value: Column, key: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """log(1 + value) of each key between two percentiles as 0 to 1; 0 where these are equal."""
    rows = points.withColumn("_log", F.log1p(value))
    ends = rows.groupBy(key).agg(F.percentile("_log", F.lit(low)).alias("_lo"), F.percentile("_log", F.lit(high)).alias("_hi"))
    share = F.coalesce(F.try_divide(F.col("_log") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return rows.join(ends, key).withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).drop("_log", "_lo", "_hi")
