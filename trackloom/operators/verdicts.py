"""Reviewers' answers over automatic labels: parsing, merging, counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import cleaned

# The vocabulary of answers and the sentinel of an offset.
YES, NO = ("yes",), ("no",)
UNSURE = ("uncertain", "unsure", "hard to tell", "unclear")
SENTINEL = "pre_obs"


def answer(text: Column) -> Column:
    """struct(answered, crosses): blank is unanswered, unsure has a null verdict, anything unknown is an error."""
    said = F.lower(cleaned(text))
    bad = F.raise_error(F.concat(F.lit("unknown answer: "), said)).cast("boolean")
    crosses = F.when(said.isin(*YES), True).when(said.isin(*NO), False).when((said == "") | said.isin(*UNSURE), F.lit(None).cast("boolean")).otherwise(bad)
    return F.struct((said != "").alias("answered"), crosses.alias("crosses"))


def offset(text: Column) -> Column:
    """struct(seconds, before): a signed number, or the sentinel; a scribble is no offset."""
    said = cleaned(text)
    seconds = F.regexp_replace(said, r"\+", "").try_cast("double")
    return F.struct(seconds.alias("seconds"), (F.lower(said) == SENTINEL).alias("before"))


def needs_time(crosses: Column, seconds: Column, before: Column) -> Column:
    """A reviewed crossing that no window can be anchored to until someone adds its time."""
    return F.coalesce(crosses & seconds.isNull() & ~F.coalesce(before, F.lit(False)), F.lit(False))


def merge(tracks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Automatic verdicts overridden by reviews (key; answered, crosses, seconds, before).

    A review that cannot tell makes the track undetermined, with no verdict. A reviewed crossing without a time is
    undetermined too, but stays a crossing; the reason says which. A time outside the tracked span
    (first_t .. last_t, where the tracks have them) is flagged and not moved. What the review replaced is kept in `overrode`; tracks
    without a review are unchanged, and `disputed` ones (where the tracks tell) stay marked.
    """
    has = lambda name, kind: F.col(name) if name in tracks.columns else F.lit(None).cast(kind)
    joined = tracks.join(reviews, "key", "left")
    reviewed = F.coalesce("answered", F.lit(False))
    said, before = F.when(reviewed, F.col("crosses")), F.coalesce("before", F.lit(False))
    timed = said & F.col("seconds").isNotNull()
    status = F.when(~reviewed, F.col("status")).when(F.coalesce(~said | timed, F.lit(False)), "determined").otherwise("undetermined")
    verdict = F.when(~reviewed, F.col("auto_crosses")).otherwise(said)
    moment = F.when(~reviewed, F.col("auto_time")).when(timed, F.col("keyframe") + F.col("seconds"))
    reason = F.when(reviewed & said.isNull(), "human_uncertain").when(said & ~timed, F.when(before, "crossing_started_before_observation").otherwise("human_gave_no_crossing_time"))
    outside = timed & ~F.col("crossing_time").between(has("first_t", "double"), has("last_t", "double"))
    changed = F.struct(F.col("auto_crosses").alias("crosses"), F.col("auto_time").alias("time"), F.col("auto_status").alias("status"))
    own = joined.withColumns({"said": said, "new_status": status, "verdict": verdict, "crossing_time": moment, "reason": reason, "reviewed": reviewed})
    return own.withColumn("auto_status", F.col("status")).select(
        "key",
        F.col("new_status").alias("status"),
        F.col("verdict").alias("crosses"),
        "crossing_time",
        "reviewed",
        "reason",
        F.coalesce(outside, F.lit(False)).alias("outside_span"),
        F.coalesce(has("disputed", "boolean") & ~F.col("reviewed"), F.lit(False)).alias("disputed"),
        F.coalesce("auto_crosses", F.lit(False)).alias("auto_crosses"),
        F.when(F.col("reviewed"), changed).alias("overrode"),
    )


def counters(merged: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """One row of counts over merged verdicts; `no_action_record` counts tracks that have none (`tracks` with has_action)."""
    seen = F.col("reviewed")
    yes, no = seen & F.coalesce("crosses", F.lit(False)), seen & ~F.coalesce("crosses", F.lit(True))
    out = merged.agg(
        F.count_if(seen).alias("human_verified"),
        F.count_if(F.col("reason") == "human_uncertain").alias("human_uncertain"),
        F.count_if(yes).alias("human_cross"),
        F.count_if(yes & ~F.col("auto_crosses")).alias("flipped_no_to_cross"),
        F.count_if(yes & (F.col("status") == "undetermined")).alias("cross_without_anchorable_t_c"),
        F.count_if(no).alias("human_no_cross"),
        F.count_if(no & F.col("auto_crosses")).alias("flipped_cross_to_no"),
        F.count_if("disputed").alias("pv_disputed_unreviewed"),
        F.count_if(~seen).alias("geometry_kept"),
        F.count("*").alias("written"),
        F.count_if("outside_span").alias("outside_span"),
    )
    if tracks is None:
        return out
    missing = tracks.agg(F.count_if(~F.col("has_action")).alias("no_action_record"))
    return out.withColumn("one", F.lit(1)).join(missing.withColumn("one", F.lit(1)), "one").drop("one")  # two single rows


def unmatched(reviews: DataFrame, tracks: DataFrame) -> DataFrame:
    """Keys of reviews without a track, each once."""
    return reviews.select("key").join(tracks.select("key"), "key", "left_anti").distinct()


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select("key").intersect(second.select("key"))


def union_batches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two batches of reviews that must not share a key: each key's batches are counted, two are an error."""
    both = first.withColumn("batch", F.lit(1)).unionByName(second.withColumn("batch", F.lit(2)))
    shared = both.groupBy("key").agg(F.count_distinct("batch").alias("n")).where("n > 1").limit(1)
    if not shared.isEmpty():
        raise ValueError(f"both batches review {shared.first()['key']}")
    return both.drop("batch")
