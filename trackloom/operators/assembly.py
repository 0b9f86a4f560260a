"""From tracks and their actions to samples: gates, window proposals, measures, labels; every skip is counted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import windows
from .temporal import neighbours, observed_fraction


@dataclass(frozen=True)
class Assembly:
    # Window length, horizons, and the limits of the gates.
    length: float = 0.5
    horizons: Sequence[float] = windows.HORIZONS
    ego_distance: float = 50.0
    road_distance: float = 15.0
    scans: int = 3
    observed: float = 0.7


def track_gate(actions: DataFrame, road_points: Column) -> Column:
    """The first reason for which a track gives no windows: undetermined, no road polygon, no point on the road."""
    return windows.gate([("no_action_record", F.col("missing")), ("undetermined_action", F.col("status") != "determined"), ("unlabeled_no_ego_road", F.col("crosses").isNull()), ("no_road_surface_points", ~road_points)])


def window_gate(config: Assembly) -> Column:
    """The first reason for which a window gives no sample, in a fixed order."""
    return windows.gate(
        [
            ("distance_to_ego", F.col("distance_to_ego") > config.ego_distance),
            ("distance_to_road", F.col("distance_to_road") > config.road_distance),
            ("lidar_availability", F.col("n_lidar") < config.scans),
            ("camera_availability", F.col("n_camera") == 0),
            ("no_track_frames", F.col("fraction").isNull()),
        ]
    )


def places_at(moments: DataFrame, frames: DataFrame, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The moments (track, frame, t) with the place of the track then: linear between its frames, constant outside."""
    near = neighbours(moments, frames, F.struct(*names))
    share = (F.col("t") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))
    at = lambda c: F.when(F.col("b").isNull(), F.col(f"a.v.{c}")).when(F.col("a").isNull() | (F.col("b.t") == F.col("t")), F.col(f"b.v.{c}")).otherwise(F.col(f"b.v.{c}") + share * (F.col(f"a.v.{c}") - F.col(f"b.v.{c}")))
    return near.select("track", "frame", *[at(c).alias(c) for c in names])


def sensors_in_windows(spans: DataFrame, records: DataFrame, width: float = 3.0, slack: float = windows.SLACK) -> DataFrame:
    """Scans and images of the sequence inside each window: an equi-join on the sequence and buckets of time. Records: seq, t, sensor."""
    cut = spans.select("seq", "track", "window", "start", "end").withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - slack) / width), F.floor((F.col("end") + slack) / width))))
    own = records.select("seq", F.floor(F.col("t") / width).alias("bucket"), F.col("t").alias("at"), "sensor")
    hit = lambda sensor: F.count_if(F.col("at").between(F.col("start") - slack, F.col("end") + slack) & (F.col("sensor") == sensor))
    return cut.join(own, ["seq", "bucket"], "left").groupBy("track", "window").agg(hit("lidar").alias("n_lidar"), hit("camera").alias("n_camera"))


def assemble(frames: DataFrame, actions: DataFrame, records: DataFrame, road: Column, ego: tuple[Column, Column], road_points: Column, config: Assembly = Assembly()) -> DataFrame:
    """A row for each sample and for each skip: seq, track, window (start in milliseconds), kind, reason (null for a sample), and the sample's fields.

    `road` is the distance to the road of a place (x, y), `ego` the vehicle's place at `mid`, `road_points` whether the
    sequence has points on the road, `actions` the tracks' records with `missing` where a track has none.
    """
    judged = written(actions.withColumn("reason", track_gate(actions, F.coalesce(road_points, F.lit(False)))), "judged-tracks")
    passing = judged.where("reason is null").drop("reason")
    rows = written(frames.join(passing.select("track"), "track", "left_semi"), "passing-frames")
    proposed = windows.propose(rows, passing, road, config.horizons, config.length, config.observed).withColumn("window", F.floor(F.col("start") * 1000 + 0.5))
    proposed = written(proposed, "proposals")  # read four times below
    good = proposed.where("skip_reason is null").join(passing.select("track", "seq"), "track").withColumn("mid", (F.col("start") + F.col("end")) / 2)
    places = places_at(good.select("track", F.col("window").alias("frame"), F.col("mid").alias("t")), rows).withColumnRenamed("frame", "window")
    counts = sensors_in_windows(good, records)
    measured = observed_fraction(good.select("track", "window", "start", "end"), rows).select("track", "window", "fraction")
    both = good.join(places, ["track", "window"]).join(counts, ["track", "window"]).join(measured, ["track", "window"])
    sized = both.withColumns({"distance_to_ego": F.sqrt((F.col("x") - ego[0]) ** 2 + (F.col("y") - ego[1]) ** 2), "distance_to_road": road}).withColumn("reason", window_gate(config))
    labelled = windows.intents(sized.withColumn("road_distance", F.col("distance_to_road")), config.horizons)
    skipped = proposed.where("skip_reason is not null").join(passing.select("track", "seq"), "track").select("seq", "track", "kind", "horizon", F.col("skip_reason").alias("reason"))
    samples = labelled.select(
        "seq", "track", "window", "kind", "horizon", "reason", "start", "end", "intent",
        *[F.element_at("labels_by_horizon", str(h)).alias(f"intent_h{str(h).replace('.', '_')}") for h in config.horizons],
        F.round("confidence", 3).alias("confidence"), F.round("distance_to_ego", 2).alias("distance_to_ego"), F.round("distance_to_road", 2).alias("distance_to_road"),
        F.round("fraction", 3).alias("observed_fraction"), "n_lidar", "n_camera",
    )
    return samples.unionByName(skipped, allowMissingColumns=True).unionByName(judged.where("reason is not null").select("seq", "track", "reason"), allowMissingColumns=True)


def samples(assembled: DataFrame) -> DataFrame:
    """The rows that became samples, with their ids."""
    return assembled.where("reason is null").withColumn("sample_id", F.concat_ws("_", "seq", "track", "window"))


def skips(assembled: DataFrame) -> DataFrame:
    return assembled.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def summary(samples: DataFrame, horizons: Sequence[float] = windows.HORIZONS) -> DataFrame:
    """One row: samples by kind, distinct pedestrians, and crossings with their ratio at every horizon."""
    hit = lambda h: F.count_if(F.col(f"intent_h{str(h).replace('.', '_')}") == "crossing")
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("tte_anchored", "closest_approach")]
    each = [c for h in horizons for c in (hit(h).alias(f"crossing_h{str(h).replace('.', '_')}"), F.round(F.try_divide(hit(h), F.count("*")), 4).alias(f"ratio_h{str(h).replace('.', '_')}"))]
    return samples.agg(F.count("*").alias("n_samples"), *kinds, F.count_distinct("seq", "track").alias("n_pedestrians"), *each)
