"""Track quality: metrics, flags, tiers, roll-ups, cuts, corpus statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .temporal import axes, in_time, step_length

# Names of flags and tiers.
FLAGS = ("EMPTY", "LOW_COVERAGE", "SHORT", "SPARSE_LIFT", "LOW_CONF", "JITTER")
BAD, MARGINAL = ("EMPTY", "JITTER"), ("LOW_COVERAGE", "SPARSE_LIFT", "LOW_CONF")


@dataclass(frozen=True)
class Thresholds:
    # The limits of the flags and of the cut for speed.
    coverage: float = 0.5
    duration: float = 3.0
    points: int = 5
    confidence: float = 0.3
    speed: float = 3.5
    fast: float = 5.0


def measured() -> Column:
    """A real measurement: observed, and with a point count (an anchor has -1)."""
    return F.col("observed") & (F.col("points") >= 0)


def track_metrics(frames: DataFrame) -> DataFrame:
    """One row a track: counts, observed share, coverage (the share of real measurements, so without anchors),
    duration, runs without observation, median points of real measurements and median confidence of all
    observed frames, greatest speed over all coordinates.

    Runs and speeds are told row by row over the track's window, so one exchange on the track serves
    the windows and all aggregates.
    """
    place, before = F.row_number().over(in_time()), F.lag("observed").over(in_time())
    seen_at = F.last(F.when(F.col("observed"), F.col("place")), ignorenulls=True).over(in_time().rowsBetween(Window.unboundedPreceding, 0))
    dt = F.col("t") - F.lag("t").over(in_time())
    rows = (
        frames.select("seq", "track", "frame", "t", "observed", "points", "confidence", place.alias("place"), before.alias("before"), dt.alias("dt"), step_length(axes(frames)).alias("step"))
        .withColumn("coasted", F.col("place") - F.coalesce(seen_at, F.lit(0)))
        .withColumn("speed", F.when(F.col("dt") > 0, F.col("step") / F.col("dt")))
    )
    return rows.groupBy("seq", "track").agg(
        F.count("*").alias("n_frames"),
        F.count_if("observed").alias("n_observed"),
        F.count_if(measured()).alias("n_measured"),
        F.avg(F.col("observed").cast("int")).alias("observed_fraction"),
        (F.count_if(measured()) / F.count("*")).alias("coverage"),
        (F.max("t") - F.min("t")).alias("duration"),
        F.coalesce(F.median(F.when(measured(), F.col("points"))).cast("int"), F.lit(0)).alias("median_points"),
        F.coalesce(F.median(F.when(F.col("observed"), F.col("confidence"))), F.lit(0.0)).alias("median_confidence"),
        F.max("coasted").cast("long").alias("longest_coast"),
        F.count_if(~F.col("observed") & F.coalesce("before", F.lit(True))).alias("n_coasts"),
        F.coalesce(F.max("speed"), F.lit(0.0)).alias("max_speed"),
    )


def flags(limits: Thresholds = Thresholds()) -> Column:
    """The flags of a row of metrics, in their fixed order; an empty track is not also one of low coverage.
    Metrics are compared as they are published: duration and speed in hundredths, shares in thousandths."""
    empty = F.col("n_measured") == 0
    conditions = {
        "EMPTY": empty,
        "LOW_COVERAGE": ~empty & (F.round("coverage", 3) < limits.coverage),
        "SHORT": F.round("duration", 2) < limits.duration,
        "SPARSE_LIFT": F.col("median_points") < limits.points,
        "LOW_CONF": F.round("median_confidence", 3) < limits.confidence,
        "JITTER": F.round("max_speed", 2) > limits.speed,
    }
    return F.array_compact(F.array(*[F.when(conditions[f], f) for f in FLAGS]))


def tier(found: Column) -> Column:
    return F.when(F.arrays_overlap(found, F.array(*map(F.lit, BAD))), "bad").when(F.arrays_overlap(found, F.array(*map(F.lit, MARGINAL))), "marginal").otherwise("good")


def track_quality(frames: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    return track_metrics(frames).withColumn("found", flags(limits)).select("*", F.array_join("found", "|").alias("flags"), F.size("found").alias("n_flags"), tier(F.col("found")).alias("tier")).drop("found")


def rollup(quality: DataFrame) -> DataFrame:
    """Tiers by sequence."""
    return quality.groupBy("seq").agg(
        F.count("*").alias("n_tracks"),
        *[F.count_if(F.col("tier") == t).alias(t) for t in ("good", "marginal", "bad")],
        F.count_if(F.contains("flags", F.lit("SHORT"))).alias("short"),
        F.avg((F.col("tier") == "good").cast("int")).alias("good_fraction"),
    )


def review_queue(quality: DataFrame, top: int = 30) -> DataFrame:
    """The `top` tracks with most flags, then lowest coverage: a report of a stated size."""
    return quality.orderBy(F.desc("n_flags"), "coverage", "track").limit(top).select("track", "n_flags", "coverage", "flags", "tier")


def cut_reasons(limits: Thresholds = Thresholds()) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.contains("flags", F.lit("JITTER")), "jitter"),
            F.when(F.col("tier") == "bad", "bad_tier"),
            F.when(F.round("max_speed", 2) > limits.fast, "fast"),
        )
    )


def cut_manifest(quality: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """How many tracks stay and go, and for what; a track may go for several reasons."""
    cut = quality.withColumn("reasons", cut_reasons(limits))
    fate = cut.select(F.when(F.size("reasons") > 0, "dropped").otherwise("kept").alias("entry"))
    why = cut.select(F.explode(F.transform("reasons", lambda r: F.concat(F.lit("reason:"), r))).alias("entry"))
    return fate.unionByName(why).groupBy("entry").agg(F.count("*").alias("n"))


def percentiles(quality: DataFrame, columns: list[str], at: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Linear percentiles of metrics over the corpus, one row each."""
    named = F.stack(F.lit(len(columns)), *[c for name in columns for c in (F.lit(name), F.col(name).cast("double"))])
    long = quality.select(named.alias("metric", "value"))
    return long.groupBy("metric").agg(*[F.percentile("value", F.lit(p)).alias(f"p{round(100 * p)}") for p in at])


def flag_counts(quality: DataFrame) -> DataFrame:
    return quality.select(F.explode(F.filter(F.split("flags", r"\|"), lambda f: f != "")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def with_span(quality: DataFrame, pool: DataFrame) -> DataFrame:
    """Adds the share of the frames of its sequence's pool (seq, n_pool) that a track spans; null where no pool is known."""
    return quality.join(pool, "seq", "left").withColumn("span_fraction", F.try_divide("n_frames", "n_pool")).drop("n_pool")


def mean_coverage(quality: DataFrame, by: str) -> DataFrame:
    return quality.groupBy(by).agg(F.count("*").alias("n_tracks"), F.avg("coverage").alias("coverage"))


def extremes(rolled: DataFrame, k: int) -> DataFrame:
    """The k sequences of the highest and of the lowest share of good tracks, the smaller id of equals: a report of a stated size."""
    best = rolled.orderBy(F.desc("good_fraction"), "seq").limit(k).withColumn("end", F.lit("cleanest"))
    return best.unionByName(rolled.orderBy("good_fraction", "seq").limit(k).withColumn("end", F.lit("roughest"))).select("end", "seq", "good_fraction")


def demo_tracks(paths: DataFrame, gaps: DataFrame, quality: DataFrame, least_gap: int = 2, observed: float = 0.6, path: float = 2.0, step: float = 1.5, top: int = 20) -> DataFrame:
    """Tracks with a bridged gap that are observed, move and do not jump; the `top` by gap and path: a report of a stated size."""
    rows = quality.select("track", "observed_fraction").join(paths.select("track", "path", "longest_step"), "track").join(gaps, "track")
    good = rows.where((F.col("gap_frames") >= least_gap) & (F.col("observed_fraction") >= observed) & (F.col("path") >= path) & (F.col("longest_step") <= step))
    return good.orderBy(F.desc("gap_frames"), F.desc("path"), "track").limit(top)
