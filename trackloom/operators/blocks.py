"""The blocks of a sample: its trajectory in the world and as the vehicle sees it, its media, its context, its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .spatial import key_member
from .temporal import asof_nearest
from .windows import SLACK


def _bucketed(spans: DataFrame, rows: DataFrame, key: str, lo: Column, hi: Column, width: float) -> DataFrame:
    """Pairs of a span and the rows of its key inside [lo, hi]: an equi-join on buckets of time, then the exact bounds."""
    cut = spans.withColumns({"lo": lo, "hi": hi}).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    own = rows.withColumn("bucket", F.floor(F.col("t") / width))
    return cut.join(own, [key, "bucket"]).where(F.col("t").between(F.col("lo"), F.col("hi")))


def trajectory(samples: DataFrame, frames: DataFrame, poses: DataFrame, ahead: float, width: float = 3.0) -> DataFrame:
    """sample_id, frames: what the track does from the window's start until `ahead` seconds after its end.

    samples (sample_id, track, start, end), frames (track, frame, t, x, y, z, observed, points, confidence), poses (sample_id,
    pose: the vehicle in the world at the window's start). Places stand in both frames of reference; frames after the window are the target and no input (see `index.positions`).
    """
    spans = samples.select("sample_id", "track", "start", "end")
    near = _bucketed(spans, frames, "track", F.col("start") - SLACK, F.col("end") + ahead + SLACK, width).join(poses.select("sample_id", "pose"), "sample_id")
    relative = dict(zip("xyz", G.untransform(F.col("pose"), F.col("x"), F.col("y"), F.col("z")), strict=True))
    place = [F.array("x", "y", "z").alias("position"), F.array(*[F.round(c, 4) for c in relative.values()]).alias("position_ego_rel")]
    one = F.struct(F.col("t").alias("ts"), "frame", *place, "observed", "points", "confidence")
    return near.groupBy("sample_id").agg(F.sort_array(F.collect_list(one)).alias("frames"))


def media(samples: DataFrame, records: DataFrame, boxes: DataFrame, width: float = 3.0) -> DataFrame:
    """sample_id, camera_frames and lidar_scans (t, path) of the sequence inside the window, in order; images with the track's box (null out of sight).

    records: (seq, t, sensor, path); boxes: (track, t, bbox) of images in which the track can be seen. Samples without records stay, with empty arrays.
    """
    spans = samples.select("sample_id", "seq", "track", "start", "end")
    near = _bucketed(spans, records, "seq", F.col("start") - SLACK, F.col("end") + SLACK, width).join(boxes, ["track", "t"], "left")
    gather = lambda sensor, *fields: F.sort_array(F.collect_list(F.when(F.col("sensor") == sensor, F.struct("t", "path", *fields))))
    found = near.groupBy("sample_id").agg(gather("camera", "bbox").alias("camera_frames"), gather("lidar").alias("lidar_scans"))
    return samples.select("sample_id").join(found, "sample_id", "left").withColumns({c: F.coalesce(c, F.array()) for c in ("camera_frames", "lidar_scans")})


def context(samples: DataFrame, signals: dict[str, DataFrame]) -> DataFrame:
    """sample_id and for each signal (seq, t, value) its value nearest to the window's start, the earlier of equals; null where a sequence has none."""
    out = samples.select("sample_id")
    moments = samples.select(F.col("seq").alias("track"), F.col("sample_id").alias("frame"), F.col("start").alias("t"))
    for name, rows in signals.items():
        near = asof_nearest(moments, rows.select(F.col("seq").alias("track"), "t", "value"), F.col("value"))
        out = out.join(near.select(F.col("frame").alias("sample_id"), F.col("match_value").alias(name)), "sample_id", "left")
    return out


def metadata(samples: DataFrame, frames: DataFrame, distance: Column, sequences: DataFrame) -> DataFrame:
    """sample_id, what is known of its sequence (`sequences`: seq and further columns), how many pedestrians it has, and whether this one comes closest."""
    scene = frames.groupBy("seq").agg(F.count_distinct("track").alias("num_pedestrians_in_scene"))
    key = key_member(frames, distance).select("seq", F.col("track").alias("_key"))
    own = samples.select("sample_id", "seq", "track").join(scene, "seq", "left").join(key, "seq", "left").join(sequences, "seq", "left")
    return own.withColumn("is_key_pedestrian", F.coalesce(F.col("track") == F.col("_key"), F.lit(False))).drop("_key")


def assembled(samples: DataFrame, *blocks: DataFrame) -> DataFrame:
    """Samples with their blocks side by side."""
    for block in blocks:
        samples = samples.join(block.drop("seq", "track"), "sample_id", "left")
    return samples
