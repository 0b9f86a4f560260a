"""The candidate pool of a sequence: scans paired with images, boxes lifted to places, and what anchored tracks claim of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import lifting
from .spatial import within
from .temporal import asof_nearest


def pairs(scans: DataFrame, images: DataFrame, most: float) -> DataFrame:
    """seq, scan, t, image: each scan (seq, scan, t) with the nearest image (seq, image, t), the earlier of equals; scans without one within `most` seconds are left out.

    An image may belong to several scans."""
    left = scans.select(F.col("seq").alias("track"), F.col("scan").alias("frame"), "t")
    right = images.select(F.col("seq").alias("track"), "t", "image")
    near = asof_nearest(left, right, F.col("image"), most).select(F.col("track").alias("seq"), F.col("frame").alias("scan"), F.col("match_value").alias("image"))
    return scans.select("seq", "scan", "t").join(near, ["seq", "scan"])


def misses(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """The images (seq, image) that are needed and that the cache has never seen, each once. An image that was seen without boxes is in the cache."""
    return pairs.select("seq", "image").distinct().join(cached.select("seq", "image").distinct(), ["seq", "image"], "left_anti")


def detected(pairs: DataFrame, cached: DataFrame, boxes: DataFrame, detector: Callable[[DataFrame], DataFrame], least: float = 0.0) -> DataFrame:
    """Boxes (seq, image, box, x1, y1, x2, y2, score) of the images in need: from the cache, and by `detector` for its misses.

    The detector gets each missing image once, however many scans share it; what it finds is written once. The threshold is applied to both alike.
    """
    columns = ["seq", "image", "box", "x1", "y1", "x2", "y2", "score"]
    needed = pairs.select("seq", "image").distinct()
    fresh = written(detector(misses(pairs, cached)).select(*columns), "detections")
    return boxes.join(needed, ["seq", "image"], "left_semi").select(*columns).unionByName(fresh).where(F.col("score") >= least)


def candidates(pairs: DataFrame, boxes: DataFrame, points: DataFrame, **lift) -> DataFrame:
    """seq, scan, t, box, x, y, z, n_points of every box that could be lifted; a paired scan without any has one row without a place,
    because a miss is information to the trackers.

    points: (scan, x, y, z, u, v), already in the image's pixels.
    """
    own = boxes.join(pairs.select("seq", "scan", "image"), ["seq", "image"]).select("scan", "box", "x1", "y1", "x2", "y2")
    lifted = lifting.lift(points, own, **lift).where("x is not null")
    return pairs.select("seq", "scan", "t").join(lifted, "scan", "left").select("seq", "scan", "t", "box", "x", "y", "z", "n_points")


def in_world(pool: DataFrame, poses: DataFrame) -> DataFrame:
    """The pool's places by the pose of each scan (seq, scan, pose: 16 numbers, world from sensor, row by row)."""
    at = lambda row: sum((F.col("pose")[4 * row + k] * F.col(c) for k, c in enumerate("xyz")), F.lit(0.0)) + F.col("pose")[4 * row + 3]
    moved = pool.join(poses.select("seq", "scan", "pose"), ["seq", "scan"])
    return moved.select("seq", "scan", "t", "box", *[at(i).alias(c) for i, c in enumerate("xyz")], "n_points")


def claims(tracks: DataFrame) -> DataFrame:
    """Places that anchored tracks (seq, t_us, x, y) hold at each scan. Coasted frames count too: the pedestrian is
    still there while nothing is measured, so no new track may begin in the gap."""
    return tracks.select("seq", "t_us", F.monotonically_increasing_id().alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))


def residual(pool: DataFrame, claims: DataFrame, radius: float) -> DataFrame:
    """The pool (seq, t_us, key, x, y, ...) without what is claimed at the same microsecond within the radius.

    Joined by cells as wide as the radius. A scan whose candidates are all claimed keeps one row without a place or key.
    """
    taken = within(pool.where("x is not null").select("key", "seq", "t_us", "x", "y"), claims, radius, ["seq", "t_us"]).select("key").distinct()
    left = pool.join(taken, "key", "left_anti")
    bare = pool.select("seq", "t_us").distinct().join(left.select("seq", "t_us").distinct(), ["seq", "t_us"], "left_anti")
    return left.unionByName(bare, allowMissingColumns=True)
