"""Boxes of a smoothed track from its motion: velocity on all axes, heading, and a fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import in_time, nearest_fill

AXES = ("x", "y", "z")


def velocities(frames: DataFrame) -> DataFrame:
    """Frames with vx, vy, vz: second-order estimates on uneven times, one-sided at the ends, 0 for a single frame. One window for all axes."""
    t = {"before_t": F.lag("t").over(in_time()), "after_t": F.lead("t").over(in_time())}
    near = {f"{side}_{c}": f(c).over(in_time()) for c in AXES for side, f in (("before", F.lag), ("after", F.lead))}
    hs, hd = F.col("t") - F.col("before_t"), F.col("after_t") - F.col("t")

    def slope(c: str):
        before, here, after = F.col(f"before_{c}"), F.col(c), F.col(f"after_{c}")
        inner = F.try_divide(hs * hs * after + (hd * hd - hs * hs) * here - hd * hd * before, hs * hd * (hs + hd))
        ends = F.coalesce(F.try_divide(after - here, F.when(before.isNull(), hd)), F.try_divide(here - before, F.when(after.isNull(), hs)))
        return F.coalesce(inner, ends, F.lit(0.0)).alias(f"v{c}")

    return frames.withColumns(t | near).select(*frames.columns, *map(slope, AXES))


def from_motion(frames: DataFrame, sizes: DataFrame, slowest: float = 0.3) -> DataFrame:
    """One box a frame: the track's place, its own size (track, length, width, height), and the heading of its velocity.

    Frames slower than `slowest` in the plane take the heading of the nearest moving frame by number of frames, the earlier of
    equals (`static_fill`); a track that never moves has heading 0 (`undefined`).
    """
    moving = velocities(frames).withColumns({"heading": F.atan2("vy", "vx"), "moves": F.hypot("vx", "vy") >= slowest})
    filled = nearest_fill(moving, F.col("heading"), F.col("moves"), keep=("t", *AXES))
    named = F.when(F.col("origin") == "own", "velocity").when(F.col("origin") == "filled", "static_fill").otherwise("undefined")
    own = filled.select("track", "frame", "t", *AXES, F.col("value").alias("yaw"), named.alias("yaw_source"))
    return own.join(sizes.select("track", "length", "width", "height"), "track")
