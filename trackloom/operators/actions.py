"""What a track does as a whole: whether and when it steps on the road."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import measured


def real_observations(frames: DataFrame) -> Column:
    """Number of real measurements: observed, and found by a pass forward or backward, so no anchor. Frames without a column `method` tell by their point count."""
    return F.count_if(F.col("observed") & F.col("method").isin("forward", "backward") if "method" in frames.columns else measured())


def label_actions(frames: DataFrame, on_road: Column, road_known: Column) -> DataFrame:
    """One record a track (seq, track): status, crosses, crossing_t, crossing_observed, n_frames, n_real, road_frames, t0, t1.

    A track without a real measurement is undetermined and has no labels. Where the road of its sequence
    is not known, a determined track has no verdict. Else it crosses if any frame is on the road, at the first such frame.
    """
    hit = F.coalesce(on_road & road_known, F.lit(False))
    first = F.min_by(F.struct("t", "observed"), F.when(hit, F.struct("t", "frame")))
    own = frames.groupBy("seq", "track").agg(
        F.count("*").alias("n_frames"), real_observations(frames).alias("n_real"), F.count_if(hit).alias("road_frames"), F.max(F.coalesce(road_known, F.lit(False))).alias("known"), first.alias("first"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    determined, crosses = F.col("n_real") > 0, F.col("road_frames") > 0
    judged = determined & F.col("known")
    moment = F.when(judged & crosses, F.col("first"))
    return own.select(
        "seq",
        "track",
        F.when(determined, "determined").otherwise("undetermined").alias("status"),
        F.when(judged, crosses).alias("crosses"),
        moment["t"].alias("crossing_t"),
        moment["observed"].alias("crossing_observed"),
        "n_frames",
        "n_real",
        F.when(judged, F.col("road_frames")).otherwise(0).alias("road_frames"),
        "t0",
        "t1",
    )


def summary(actions: DataFrame) -> DataFrame:
    """One row: tracks by outcome, and the share of crossings among the determined ones (null without any)."""
    determined, crossing = F.count_if(F.col("status") == "determined"), F.count_if(F.coalesce("crosses", F.lit(False)))
    return actions.agg(F.count("*").alias("n_tracks"), determined.alias("n_determined"), F.count_if(F.col("status") != "determined").alias("n_undetermined"), crossing.alias("n_crossing"), F.try_divide(crossing, determined).alias("crossing_rate"))


def with_actions(tracks: DataFrame, actions: DataFrame) -> DataFrame:
    """The tracks (seq, track, ...) with their action records; `missing` marks those that have none."""
    return tracks.join(actions.withColumn("_known", F.lit(True)), ["seq", "track"], "left").withColumn("missing", F.col("_known").isNull()).drop("_known")


def only_for(actions: DataFrame, tracks: DataFrame) -> DataFrame:
    """The action records of the tracks that are wanted (seq, track), each record once."""
    return actions.join(tracks.select("seq", "track"), ["seq", "track"], "left_semi")


# The banners' three shapes.
UNDETERMINED, CROSSES, STAYS = "%s: UNDETERMINED (empty track)", "%s: CROSSES ROAD  t_c=%+.1fs", "%s: no road cross"


def banners(actions: DataFrame, keyframes: DataFrame, prefix: str = "") -> DataFrame:
    """seq, track, banner: one line on what each track does, with the crossing's time from the keyframe (seq, moment) in signed tenths of a second.

    Only tracks whose id begins with `prefix`. A crossing without a time, or in a sequence without a keyframe, says so without it.
    """
    key = F.col("track").cast("string")
    wanted = actions.where(key.startswith(prefix)).join(keyframes.select("seq", "moment"), "seq", "left")
    after = F.col("crossing_t") - F.col("moment")
    name = F.left(key, F.lit(8))
    crossing = F.when(after.isNull(), F.format_string(CROSSES.split("  ")[0], name)).otherwise(F.format_string(CROSSES, name, after))
    text = F.when(F.col("status") != "determined", F.format_string(UNDETERMINED, name)).when(F.coalesce("crosses", F.lit(False)), crossing).otherwise(F.format_string(STAYS, name))
    return wanted.select("seq", "track", text.alias("banner"))
