"""Windows before events, their gates, labels, and what becomes of every proposal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .temporal import first_true

HORIZONS = (1.0, 1.5, 2.0)
LENGTH, SLACK, LEAST_OBSERVED = 0.5, 1e-4, 0.7


def event_windows(frames: DataFrame, condition: Column, horizons: Sequence[float] = HORIZONS, length: float = LENGTH) -> DataFrame:
    """One proposal a horizon for each track with an event: the window that ends a horizon before it.

    `skip_reason` tells whether it fits into the track; of windows with equal start (in
    milliseconds) the one of the later horizon in the list is kept.
    """
    return before_events(first_true(frames, condition, spans=True).where("onset_t is not null"), horizons, length)


def before_events(onset: DataFrame, horizons: Sequence[float] = HORIZONS, length: float = LENGTH) -> DataFrame:
    """The same for events that are known: track, t0, t1, onset_t, onset_observed."""
    each = onset.select("track", "t0", "t1", "onset_t", "onset_observed", F.posexplode(F.array(*[F.lit(h) for h in horizons])).alias("place", "horizon"))
    cut = each.withColumn("end", F.col("onset_t") - F.col("horizon")).withColumn("start", F.col("end") - length)
    fits = (F.col("start") >= F.col("t0") - SLACK) & (F.col("end") <= F.col("t1") + SLACK)
    named = cut.withColumn("start_ms", F.floor(F.col("start") * 1000 + 0.5)).withColumn("skip_reason", F.when(~fits, "window_outside_track"))
    last = F.row_number().over(Window.partitionBy("track", "start_ms").orderBy(F.desc("place")))
    return named.withColumn("rank", last).where("rank = 1").select("track", F.col("place").alias("window"), "horizon", "start", "end", "onset_t", "onset_observed", "skip_reason")


def best_observed_window(frames: DataFrame, distance: Column, length: float = LENGTH, least: float = LEAST_OBSERVED) -> DataFrame:
    """For each track the window around its observed frame of smallest distance that is observed enough.

    The set form of a search in order of distance: each observed frame proposes the window that ends
    there (moved into the track), the first that suffices by (distance, t, frame) is taken. The observed share of the
    window that ends at a frame is a running frame over time; windows moved to the track's start share one value.
    A track without a window keeps its row and says why: shorter than a window, or never observed enough.
    """
    whole = Window.partitionBy("track")
    nanos = F.round(F.col("t") * 1e9).cast("long")  # frames by range count in whole numbers
    running = whole.orderBy(nanos).rangeBetween(-round((length + SLACK) * 1e9), round(SLACK * 1e9))
    seen = F.col("observed").cast("int")
    rows = frames.withColumns({"t0": F.min("t").over(whole), "t1": F.max("t").over(whole), "distance": distance, "here": F.avg(seen).over(running)})
    rows = rows.withColumn("opening", F.avg(F.when(F.col("t") <= F.col("t0") + length + SLACK, seen)).over(whole))
    end = F.least(F.greatest(F.col("t"), F.col("t0") + length), F.col("t1"))
    share = F.when(F.col("t") >= F.col("t0") + length, F.col("here")).otherwise(F.col("opening"))
    good = F.col("observed") & F.col("distance").isNotNull() & (share >= least)
    proposal = F.struct(F.col("frame").alias("window"), "distance", (end - length).alias("start"), end.alias("end"), share.alias("fraction"))
    best = F.min_by(proposal, F.when(good, F.struct("distance", "t", "frame")))
    found = rows.groupBy("track").agg(best.alias("b"), F.max(F.coalesce(good, F.lit(False))).alias("any"), (F.max("t1") - F.min("t0")).alias("span"))
    short = F.col("span") < length - SLACK
    reason = F.when(short, "window_outside_track").when(~F.col("any"), "comparison_window_unobserved")
    taken = F.when(reason.isNull(), F.col("b"))
    return found.select("track", *[taken[c].alias(c) for c in ("window", "distance", "start", "end", "fraction")], reason.alias("skip_reason"))


def propose(frames: DataFrame, actions: DataFrame, distance: Column, horizons: Sequence[float] = HORIZONS, length: float = LENGTH, least: float = LEAST_OBSERVED) -> DataFrame:
    """Window proposals of determined tracks: before the crossing for those that cross, one a horizon; at the closest
    observed approach for the others. `actions`: track, crosses, crossing_t, crossing_observed, t0, t1. Windows with equal start (in
    milliseconds) of one track are one."""
    cross = actions.where("crosses").select("track", "t0", "t1", F.col("crossing_t").alias("onset_t"), F.col("crossing_observed").alias("onset_observed"))
    before = before_events(cross, horizons, length).withColumn("kind", F.lit("tte_anchored"))
    others = frames.join(actions.where("not crosses").select("track"), "track", "left_semi")
    closest = best_observed_window(others, distance, length, least).select("track", "start", "end", "skip_reason", F.lit("closest_approach").alias("kind"))
    return before.drop("window").unionByName(closest, allowMissingColumns=True)


def label(end: Column, onset: Column, horizon: Column) -> Column:
    """Crossing if the event falls between the end of the window and the horizon after it."""
    return F.when((onset >= end - SLACK) & (onset <= end + horizon + SLACK), "crossing").otherwise("not_crossing")


def intents(windows: DataFrame, horizons: Sequence[float] = HORIZONS) -> DataFrame:
    """Labels at every horizon (a map and flat columns), the label at the window's own horizon, and a
    confidence: the observed share, less where the event itself was coasted or a non-crosser is close.
    The soft label gives all weight to the label."""
    at = [label(F.col("end"), F.col("onset_t"), F.lit(h)) for h in horizons]
    own = F.coalesce(label(F.col("end"), F.col("onset_t"), F.col("horizon")), F.lit("not_crossing"))
    factor = F.when((own == "crossing") & ~F.col("onset_observed"), 0.6).when((own != "crossing") & (F.col("road_distance") < 1.0), 0.7).otherwise(1.0)
    return windows.select(
        "*",
        F.map_from_arrays(F.array(*[F.lit(str(h)) for h in horizons]), F.array(*at)).alias("labels_by_horizon"),
        own.alias("intent"),
        (F.col("fraction") * factor).alias("confidence"),
        F.struct(*[(own == n).cast("double").alias(f"p_{n}") for n in ("crossing", "not_crossing")], F.lit(0.0).alias("p_uncertain")).alias("soft_label"),
    )


def gate(conditions: Sequence[tuple[str, Column]]) -> Column:
    """The first failing gate's name in order, null if all hold."""
    reason = F.lit(None).cast("string")
    for name, failing in reversed(conditions):
        reason = F.when(failing, name).otherwise(reason)
    return reason


def skip_histogram(proposals: DataFrame) -> DataFrame:
    """Counts by reason, accepted ones included, so that they add up to the proposals."""
    return proposals.groupBy(F.coalesce("skip_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def parts(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of the track by part: observed (up to the end, without slack), future and all."""
    both = windows.select("track", "window", "end").join(frames.select("track", "t"), "track")
    past = F.col("t") <= F.col("end")
    return both.groupBy("track", "window").agg(F.count_if(past).alias("n_observed"), F.count_if(~past).alias("n_future"), F.count("*").alias("n_all"))


def select_part(frames: Column, end: Column, part: str) -> Column:
    """Frames (an array of structs with ts) of one part of a sample: what a model may see, or what comes after."""
    if part == "all":
        return frames
    if part not in ("observed", "future"):
        raise ValueError(f"unknown part: {part}")
    return F.filter(frames, (lambda f: f["ts"] <= end) if part == "observed" else (lambda f: f["ts"] > end))
