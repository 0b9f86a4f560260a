"""Distances between points by grid cells: nearest surface, claimed places, gated candidates, key members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written


def _distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return F.sqrt(dx * dx + dy * dy)


def _cells(x: Column, y: Column, width: float, around: bool = False) -> Column:
    cx, cy = F.floor(x / width), F.floor(y / width)
    if not around:
        return F.struct(cx.alias("cx"), cy.alias("cy"))
    near = [F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.explode(F.array(*near))


def within(points: DataFrame, others: DataFrame, radius: float, on: list[str]) -> DataFrame:
    """Pairs of points (key, x, y) and others (other, ox, oy) of equal `on` within the radius.

    Cells are as wide as the radius; the others stand in their cell and its eight neighbours, so no
    pair is lost and only near points meet.
    """
    a = points.withColumn("cell", _cells(F.col("x"), F.col("y"), radius))
    b = others.withColumn("cell", _cells(F.col("ox"), F.col("oy"), radius, around=True))
    return a.join(b, [*on, "cell"]).withColumn("distance", _distance("x", "y", "ox", "oy")).where(F.col("distance") <= radius)


def unclaimed(points: DataFrame, claims: DataFrame, radius: float, on: list[str]) -> DataFrame:
    """Points with every claim of the same `on` farther than the radius."""
    taken = within(points, claims, radius, on).select("key").distinct()
    return points.join(taken, "key", "left_anti")


def nearest_in_gate(points: DataFrame, others: DataFrame, gate: float, on: list[str]) -> DataFrame:
    """For each point the nearest other inside the gate, the smaller id of equals; points without one stay, with nulls."""
    best = within(points, others, gate, on).groupBy("key").agg(F.min(F.struct("distance", "other")).alias("b"))
    return points.select("key").join(best, "key", "left").select("key", F.col("b.other").alias("other"), F.col("b.distance").alias("distance"))


def nearest_distance(points: DataFrame, surface: DataFrame, width: float, on: list[str], rings: int = 4) -> DataFrame:
    """For each point (key, x, y) the distance to the nearest surface point (ox, oy) of equal `on`; null without any.

    Cells are searched in widening radii: what has a surface point within the radius is settled, the
    rest goes on with twice the radius; each round is a written table, so the rounds' plans do not
    pile up. For what is left after `rings` cells bound the distance, and only cells that can hold the
    nearest point are opened, so nothing is approximated.
    """
    left, settled, radius = points, [], width
    for _ in range(rings):
        found = within(left, surface, radius, on).groupBy("key").agg(F.min("distance").alias("distance"))
        both = written(left.join(found, "key", "left"), "nearest")
        settled.append(both.where("distance is not null").select("key", "distance"))
        left = both.where("distance is null").drop("distance")
        radius *= 2
        if left.isEmpty():
            break
    else:
        far = _far_distance(left, surface, radius, on)
        settled.append(left.select("key").join(far, "key", "left"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _far_distance(points: DataFrame, surface: DataFrame, width: float, on: list[str]) -> DataFrame:
    """Exact for far points: cell summaries bound the distance, and only cells within the bound are opened."""
    own = surface.withColumn("cell", _cells(F.col("ox"), F.col("oy"), width))
    cells = own.groupBy(*on, "cell").agg(F.min("ox").alias("x0"), F.max("ox").alias("x1"), F.min("oy").alias("y0"), F.max("oy").alias("y1"))
    gap = lambda c, lo, hi: F.greatest(F.col(lo) - F.col(c), F.col(c) - F.col(hi), F.lit(0.0))
    reach = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(c) - F.col(hi)))
    low = F.sqrt(gap("x", "x0", "x1") ** 2 + gap("y", "y0", "y1") ** 2)
    high = F.sqrt(reach("x", "x0", "x1") ** 2 + reach("y", "y0", "y1") ** 2)
    bounds = points.join(cells, on).withColumn("low", low).withColumn("high", high)
    limit = bounds.groupBy("key").agg(F.min("high").alias("limit"))
    open_cells = bounds.join(limit, "key").where("low <= limit").select("key", "x", "y", *on, "cell")
    return open_cells.join(own, [*on, "cell"]).groupBy("key").agg(F.min(_distance("x", "y", "ox", "oy")).alias("distance"))


def key_member(frames: DataFrame, distance: Column) -> DataFrame:
    """For each sequence the track that comes closest, the smaller id of equals."""
    closest = frames.groupBy("seq", "track").agg(F.min(distance).alias("closest"))
    return closest.groupBy("seq").agg(F.min(F.struct("closest", "track")).alias("k")).select("seq", F.col("k.track").alias("track"), F.col("k.closest").alias("closest"))
