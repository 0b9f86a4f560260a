"""Operators over frames in time order within a track.

All take a frames DataFrame with the columns track, frame and t (seconds) and use window functions, so a
track is sorted and streamed, never gathered into one row; frames of equal time are ordered by `frame`.
Windows look back only, over the order or its reverse, so their cost grows with the track's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec



def in_time() -> WindowSpec:
    return Window.partitionBy("track").orderBy("t", "frame")


def back_in_time() -> WindowSpec:
    return Window.partitionBy("track").orderBy(F.desc("t"), F.desc("frame"))


def axes(frames: DataFrame) -> list[str]:
    """The coordinates that the frames have."""
    return [c for c in ("x", "y", "z") if c in frames.columns]


def step_length(names: list[str]) -> Column:
    """Distance from the frame before."""
    return F.sqrt(sum(((F.col(c) - F.lag(c).over(in_time())) ** 2 for c in names), F.lit(0.0)))


def coast_runs(frames: DataFrame) -> DataFrame:
    """Runs of frames without observation (gaps and islands): track, run, n_frames, t_start, t_end, internal.

    A run is internal if frames were observed before and after it.
    """
    seen = F.col("observed").cast("int")
    marked = frames.select(
        "track",
        "frame",
        "t",
        "observed",
        F.sum(seen).over(in_time()).alias("run"),
        F.sum(seen).over(Window.partitionBy("track")).alias("all_seen"),
    )
    runs = marked.where(~F.col("observed")).groupBy("track", "run").agg(F.count("*").alias("n_frames"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.first("all_seen").alias("all_seen"))
    return runs.select("track", "run", "n_frames", "t_start", "t_end", ((F.col("run") > 0) & (F.col("run") < F.col("all_seen"))).alias("internal"))


def longest_bridged(frames: DataFrame) -> DataFrame:
    """The longest internal run of each track, the first of equals: gap_frames, gap_seconds (last minus first frame of the run)."""
    best = coast_runs(frames).where("internal").groupBy("track").agg(F.max_by(F.struct("n_frames", "t_start", "t_end"), F.struct("n_frames", -F.col("t_start"))).alias("b"))
    return best.select("track", F.col("b.n_frames").alias("gap_frames"), (F.col("b.t_end") - F.col("b.t_start")).alias("gap_seconds"))


def speeds(frames: DataFrame) -> DataFrame:
    """Length of the step from the frame before by second, over all coordinates, where time moved on."""
    dt = F.col("t") - F.lag("t").over(in_time())
    return frames.withColumns({"dt": dt, "step": step_length(axes(frames))}).where("dt > 0").select("track", "frame", "dt", (F.col("step") / F.col("dt")).alias("speed"))


def paths(frames: DataFrame) -> DataFrame:
    """Over the observed frames of each track: their number, the length of the path and its longest step."""
    steps = frames.where("observed").withColumn("step", step_length(axes(frames)))
    return steps.groupBy("track").agg(F.count("*").alias("n_observed"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.coalesce(F.max("step"), F.lit(0.0)).alias("longest_step"))


def gradient(frames: DataFrame, value: str = "x") -> DataFrame:
    """Second-order derivative estimate on uneven times; one-sided at the ends; null for a single frame."""
    near = {"before_t": F.lag("t"), "after_t": F.lead("t"), "before_x": F.lag(value), "after_x": F.lead(value)}
    rows = frames.select("track", "frame", "t", F.col(value).alias("x"), *[c.over(in_time()).alias(n) for n, c in near.items()])
    hs, hd = F.col("t") - F.col("before_t"), F.col("after_t") - F.col("t")
    inner = (hs * hs * F.col("after_x") + (hd * hd - hs * hs) * F.col("x") - hd * hd * F.col("before_x")) / (hs * hd * (hs + hd))
    left, right = (F.col("after_x") - F.col("x")) / hd, (F.col("x") - F.col("before_x")) / hs
    return rows.select("track", "frame", F.coalesce(inner, left, right).alias("velocity"))


def nearest_fill(frames: DataFrame, value: Column, known: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """`value` of the nearest known frame by number of frames, the earlier of equals; 0 and "undefined" without any. Columns in `keep` go along."""
    place = F.row_number().over(in_time())
    rows = frames.withColumn("place", place).withColumn("own", F.when(known, F.struct(F.col("place"), value.alias("v"))))
    before = F.last("own", ignorenulls=True).over(in_time().rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("own", ignorenulls=True).over(back_in_time().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"b": before, "a": after})
    back, ahead = F.col("place") - F.col("b.place"), F.col("a.place") - F.col("place")
    chosen = F.when(F.col("a").isNull() | (back <= ahead), F.col("b")).otherwise(F.col("a"))
    return rows.select(
        "track",
        "frame",
        *keep,
        F.coalesce(chosen["v"], F.lit(0.0)).alias("value"),
        F.when(F.col("own").isNotNull(), "own").when(chosen.isNull(), "undefined").otherwise("filled").alias("origin"),
    )


def first_true(frames: DataFrame, condition: Column, spans: bool = False) -> DataFrame:
    """The first frame of each track where the condition holds; tracks without one are kept with
    nulls. `spans` adds the track's first and last time."""
    hit = F.min_by(F.struct("frame", "t", "observed"), F.when(condition, F.struct("t", "frame")))
    found = frames.groupBy("track").agg(F.max(condition.cast("int")).alias("any"), hit.alias("hit"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    own = F.when(F.col("any") == 1, F.col("hit"))
    onset = [own["frame"].alias("onset_frame"), own["t"].alias("onset_t"), own["observed"].alias("onset_observed")]
    return found.select("track", *onset, *(["t0", "t1"] if spans else []))


def neighbours(left: DataFrame, right: DataFrame, value: Column, key: str = "track") -> DataFrame:
    """The left rows (key, t, frame) with the last right row at or before them (b) and the first after them (a), each
    struct<t, v>. Both sides stand in one column of times, right rows before left ones of the same time."""
    own = right.select(key, "t", *(["frame"] if "frame" in right.columns else []), F.struct(F.col("t").alias("t"), value.alias("v")).alias("r"), F.lit(0).alias("side"))
    line = left.select(key, "t", "frame", F.lit(1).alias("side")).unionByName(own, allowMissingColumns=True)
    order = ["t", "side", "frame"]
    ahead, back = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    both = line.withColumns(
        {
            "b": F.last("r", ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, 0)),
            "a": F.last("r", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    return both.where("side = 1").drop("r", "side")


def asof_backward(left: DataFrame, right: DataFrame, value: Column) -> DataFrame:
    """For each left frame the value of the last right row at or before it (null without one)."""
    return neighbours(left, right, value).select("track", "frame", F.col("b.t").alias("match_t"), F.col("b.v").alias("match_value"))


def asof_nearest(left: DataFrame, right: DataFrame, value: Column, tolerance: float | None = None) -> DataFrame:
    """The nearest right row, the earlier of equals, with its value (of any type) and the gap in time.

    With a tolerance, left frames without a right row so near are dropped; without one all stay, with nulls
    where there is no right row at all.
    """
    back, ahead = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
    chosen = F.when(F.col("a").isNull() | (back <= ahead), F.col("b")).otherwise(F.col("a"))
    found = neighbours(left, right, value).withColumn("m", chosen).withColumn("gap", F.abs(F.col("t") - F.col("m.t")))
    if tolerance is not None:
        found = found.where(F.col("gap") <= tolerance)
    return found.select("track", "frame", F.col("m.t").alias("match_t"), F.col("m.v").alias("match_value"), "gap")


def interpolate(left: DataFrame, right: DataFrame, value: Column) -> DataFrame:
    """The right value at each left time: linear between its neighbours, constant outside."""
    share = (F.col("t") - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))
    between = F.col("b.v") + share * (F.col("a.v") - F.col("b.v"))
    at = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull() | (F.col("b.t") == F.col("t")), F.col("b.v")).otherwise(between)
    return neighbours(left, right, value).select("track", "frame", at.alias("value"))


def _bucketed(windows: DataFrame, frames: DataFrame, slack: float, width: float, how: str) -> DataFrame:
    lo, hi = F.floor((F.col("start") - slack) / width), F.floor((F.col("end") + slack) / width)
    cut = windows.withColumn("bucket", F.explode(F.sequence(lo, hi)))
    own = frames.select("track", F.floor(F.col("t") / width).alias("bucket"), F.col("t").alias("frame_t"), "frame", "observed", "points", "x")
    return cut.join(own, ["track", "bucket"], how)


def _inside(slack: float) -> Column:
    return (F.col("frame_t") >= F.col("start") - slack) & (F.col("frame_t") <= F.col("end") + slack)


def in_windows(windows: DataFrame, frames: DataFrame, slack: float = 1e-4, width: float = 3.0) -> DataFrame:
    """Frames inside windows (track, window, start, end), closed and with slack: an equi-join on
    buckets of `width` seconds, so that a track's windows meet only frames of their own time."""
    return _bucketed(windows, frames, slack, width, "inner").where(_inside(slack)).drop("bucket")


def observed_fraction(windows: DataFrame, frames: DataFrame, slack: float = 1e-4, width: float = 3.0) -> DataFrame:
    """The windows with the number of their frames and the observed share of these (null without frames).

    One join and one aggregate: windows keep their other columns, and those without frames stay.
    """
    hit = F.coalesce(_inside(slack), F.lit(False))
    others = [c for c in windows.columns if c not in ("track", "window")]
    return (
        _bucketed(windows, frames, slack, width, "left")
        .groupBy("track", "window")
        .agg(*[F.first(c).alias(c) for c in others], F.count_if(hit).alias("n_frames"), F.avg(F.when(hit, F.col("observed").cast("int"))).alias("fraction"))
    )


def gaps(records: DataFrame, key: str, limit: float) -> DataFrame:
    """Records of each key (t, frame), their longest gap in time (null for one record), and whether no gap is beyond the limit."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t", "frame"))
    own = records.select(key, gap.alias("gap")).groupBy(key).agg(F.count("*").alias("n_records"), F.max("gap").alias("longest_gap"))
    return own.withColumn("steady", F.coalesce(F.col("longest_gap") <= limit, F.lit(True)))
