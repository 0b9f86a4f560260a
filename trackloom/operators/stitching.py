"""Stitching of track fragments: ends, continuation edges, greedy chains, and what becomes of the frames."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import release, written
from .quality import measured


@dataclass(frozen=True)
class Gates:
    gap: float = 2.0
    overlap: float = 0.3
    residual: float = 1.0
    residual_per_second: float = 1.0
    height: float = 0.6
    recent: int = 5


def track_ends(frames: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """First and last measured place (x, y) of each track, velocity over the last few, median height (`points` stands in where there is none).

    A track is gold where a frame of it is an anchor (`anchor`, if there is such a column)."""
    gold = frames.groupBy("track").agg(F.bool_or("anchor").alias("gold")) if "anchor" in frames.columns else None
    rows = frames.where(measured())
    latest = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("t"), F.desc("frame")))
    rows = rows.withColumn("latest", latest).withColumn("recent", F.col("latest") <= gates.recent)
    tail = lambda f, c: f(F.when(F.col("recent"), F.col(c)), F.when(F.col("recent"), F.struct("t", "frame")))
    at = F.struct("t", "frame")
    ends = rows.groupBy("seq", "track").agg(
        F.count("*").alias("n_measured"),
        *[f(c, at).alias(f"{name}_{c}") for name, f in (("first", F.min_by), ("last", F.max_by)) for c in ("t", "x", "y")],
        *[tail(F.min_by, c).alias(f"tail_{c}") for c in ("t", "x", "y")],
        F.median("points").alias("height"),
    )
    speed = lambda c: F.coalesce(F.try_divide(F.col(f"last_{c}") - F.col(f"tail_{c}"), F.col("last_t") - F.col("tail_t")), F.lit(0.0)).alias(f"velocity_{c}")
    moving = ends.select("*", speed("x"), speed("y")).drop("tail_t", "tail_x", "tail_y")
    return moving.withColumn("gold", F.lit(False)) if gold is None else moving.join(gold, "track")


def continuation_edges(ends: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """Pairs of tracks of a sequence where the second may go on with the first: an equi-join on the
    sequence and on buckets of time as wide as the gap, then the gates. The residual is planar: how far the second begins from where the
    first would be by then."""
    width = gates.gap + gates.overlap
    bucket = lambda c: F.floor(c / width)
    a = ends.select("seq", *[F.col(c).alias(f"a_{c}") for c in ends.columns if c != "seq"]).withColumn("bucket", F.explode(F.sequence(bucket(F.col("a_last_t") - gates.overlap), bucket(F.col("a_last_t") + gates.gap))))
    b = ends.select("seq", *[F.col(c).alias(f"b_{c}") for c in ends.columns if c != "seq"]).withColumn("bucket", bucket(F.col("b_first_t")))
    gap = F.col("b_first_t") - F.col("a_last_t")
    ahead = F.greatest(gap, F.lit(0.0))  # fragments that overlap are compared as they are, not led back in time
    off = lambda c: F.col(f"a_last_{c}") + F.col(f"a_velocity_{c}") * ahead - F.col(f"b_first_{c}")
    miss = F.sqrt(off("x") * off("x") + off("y") * off("y"))
    allowed = gates.residual + gates.residual_per_second * ahead
    pairs = a.join(b, ["seq", "bucket"]).where((F.col("a_track") != F.col("b_track")) & (F.col("b_first_t") > F.col("a_first_t")) & (gap >= -gates.overlap) & (gap <= gates.gap))
    return pairs.where((F.abs(F.col("a_height") - F.col("b_height")) <= gates.height) & (miss <= allowed)).select(
        "seq", F.col("a_track").alias("track"), F.col("b_track").alias("follower"), gap.alias("gap"), miss.alias("residual"), allowed.alias("allowed"), F.col("a_last_t").alias("ends"), F.col("b_first_t").alias("starts")
    )


def successors(edges: DataFrame) -> DataFrame:
    """The edges that are chosen: tracks by the time they end, each takes the free follower of smallest
    (rounded residual, start); a follower is taken once. One sequence's edges at a time, since each
    choice depends on earlier ones; a sequence is one clip.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(rounded=rows["residual"].round(3)).sort_values(["ends", "track", "rounded", "starts", "follower"])
        after: set[int] = set()
        taken: set[int] = set()
        chosen = []
        for i, track, follower in zip(rows.index, rows["track"], rows["follower"], strict=True):
            if track not in after and follower not in taken:
                after.add(track)
                taken.add(follower)
                chosen.append(i)
        return rows.loc[chosen].drop(columns="rounded")

    return edges.groupBy("seq").applyInPandas(choose, edges.schema)


def chains(edges: DataFrame) -> DataFrame:
    """seq, chain (its first track), place, track of every chain of at least two tracks."""
    return walk(written(successors(edges), "successors"))


def walk(links: DataFrame) -> DataFrame:
    """Follows links (seq, track, follower; at most one of each) from the tracks that follow none.

    Every track knows one before it and how many steps away; each round joins these on themselves and doubles the
    steps, so a chain of n tracks takes log2(n) rounds. (Spark's recursive SQL walks one step a round, and by default ends at a million rows.)
    """
    behind = links.select("seq", F.col("follower").alias("own"), F.col("track").alias("up"), F.lit(1).alias("place"))
    heads = links.select("seq", F.col("track").alias("own")).join(behind.select("seq", "own"), ["seq", "own"], "left_anti").select("seq", "own", F.col("own").alias("up"), F.lit(0).alias("place"))
    known = written(behind.unionByName(heads), "walk")
    while True:
        ahead = known.select("seq", F.col("own").alias("up"), F.col("up").alias("further"), F.col("place").alias("more"))
        known, before = written(known.join(ahead, ["seq", "up"]).select("seq", "own", F.col("further").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved")), "walk"), known
        release(before)
        if not known.where("moved").head(1):
            return known.select("seq", F.col("up").alias("chain"), "place", F.col("own").alias("track"))


def proposals(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """One row a chain: its members in order, the primary that keeps its identity (gold before silver, then most
    measurements, then first in the chain), the fragments to merge into it, and the evidence of each link."""
    links = written(successors(edges), "successors")
    own = walk(links).join(ends.select("seq", "track", "n_measured", "gold"), ["seq", "track"])
    after = links.select("seq", "track", F.struct(F.col("track").alias("from"), F.col("follower").alias("to"), F.round("gap", 3).alias("gap"), F.round("residual", 3).alias("residual"), F.round("allowed", 3).alias("allowed")).alias("link"))
    members = own.join(after, ["seq", "track"], "left")
    best = F.max_by(F.struct("track", "gold"), F.struct("gold", "n_measured", (-F.col("place")).alias("order")))
    ordered = lambda c, name: F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda m: m[name])
    groups = members.groupBy("seq", "chain").agg(best.alias("best"), ordered("track", "track").alias("member_ids"), F.transform(F.array_sort(F.filter(F.collect_list(F.struct("place", "link")), lambda m: m["link"].isNotNull())), lambda m: m["link"]).alias("links"))
    fragments = F.filter("member_ids", lambda m: m != F.col("best.track"))
    return groups.select("seq", "chain", F.col("best.track").alias("primary_id"), F.col("best.gold").alias("primary_gold"), "member_ids", fragments.alias("fragment_ids"), "links")


def members_of(groups: DataFrame) -> DataFrame:
    """chain, key, place, primary, primary_gold of the members of proposals: the manifest that `resolve` reads."""
    rows = groups.select("chain", "primary_id", "primary_gold", F.posexplode("member_ids").alias("place", "key"))
    return rows.select("chain", "key", "place", (F.col("key") == F.col("primary_id")).alias("primary"), "primary_gold")


def merge_frames(frames: DataFrame) -> DataFrame:
    """One frame for each time of a track: observed before coasted, then more points, then the lower rank."""
    first = F.row_number().over(Window.partitionBy("track", "t_us").orderBy(F.desc("observed"), F.desc("points"), "rank", "frame"))
    return frames.withColumn("order", first).where("order = 1").drop("order")


def resolve(tracks: DataFrame, members: DataFrame) -> DataFrame:
    """What becomes of tracks (key, gold) that stand in groups (chain, key, primary, primary_gold).

    Gold members (also of unknown tier) are never absorbed. Other members are dropped where the group's primary is gold, whether or not
    that primary was cut; they are folded into a silver primary, and stand alone where it was cut.
    """
    own = members.join(tracks, "key")
    primary = own.where("primary").select("chain", F.col("key").alias("into"))
    roles = own.join(primary, "chain", "left")
    absorbable = ~F.col("primary") & ~F.coalesce("gold", F.lit(True))
    folds = absorbable & ~F.col("primary_gold") & F.col("into").isNotNull()
    fate = roles.select("key", F.when(absorbable & F.col("primary_gold"), "drop").when(folds, "fold").otherwise("keep").alias("fate"), F.when(folds, F.col("into")).alias("into"))
    return tracks.join(fate, "key", "left").withColumn("fate", F.coalesce("fate", F.lit("keep")))


def fold(frames: DataFrame, resolved: DataFrame, members: DataFrame) -> DataFrame:
    """Frames of one pedestrian each: dropped tracks are gone, folded ones carry the primary's id and keep theirs as `came_from`.

    Where two of them claim one instant the better frame stays (`merge_frames`; at last the primary's, then the earlier member's). Tracks that nothing is folded into keep all
    their frames. Gaps between fragments stay gaps.
    """
    order = members.select("key", F.when(F.col("primary"), -1).otherwise(F.col("place")).alias("rank"))
    fates = resolved.where("fate <> 'drop'").select("key", "into").join(order, "key", "left")
    into = fates.where("into is not null").select(F.col("into").alias("key")).distinct().withColumn("merges", F.lit(True))
    roles = fates.join(into, "key", "left").select(F.col("key").alias("track"), "into", F.coalesce("rank", F.lit(-1)).alias("rank"), (F.col("into").isNotNull() | F.coalesce("merges", F.lit(False))).alias("merges"))
    own = frames.join(roles, "track").withColumns({"came_from": F.col("track"), "track": F.coalesce("into", "track")}).drop("into")
    once = merge_frames(own.where("merges"))
    return own.where("not merges").unionByName(once).drop("merges", "rank")


def fold_stats(folded: DataFrame, resolved: DataFrame, members: DataFrame) -> DataFrame:
    """Counts of each pedestrian's frames after the fold, and the fragments that were folded in, in the order of their chain."""
    counts = folded.groupBy("track").agg(F.count("*").alias("n_frames"), F.count_if("observed").alias("n_observed"))
    came = resolved.where("into is not null").join(members.select("key", "place"), "key").groupBy(F.col("into").alias("track"))
    stitched = came.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda m: m["key"]).alias("stitched_from"))
    share = F.round(F.col("n_observed") / F.col("n_frames"), 4)
    rows = counts.join(stitched, "track", "left")
    return rows.select("track", "n_frames", "n_observed", (F.col("n_frames") - F.col("n_observed")).alias("n_coasted"), share.alias("observed_fraction"), "stitched_from")
