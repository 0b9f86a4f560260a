"""Ranking metrics, class balance, statistics over seeds, and features for a scorer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking_metrics(scored: DataFrame, width: float = 1 / 1024) -> DataFrame:
    """roc_auc, average_precision, majority_accuracy, positive_rate of (label 0/1, score).

    Equal scores are one step. Rows are counted by score first. Cumulative counts are made inside
    buckets of scores (`width`) and start from the totals of the buckets above, so that no task
    gets all scores. No row unless both labels occur.
    """
    steps = scored.groupBy("score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n")).withColumn("bucket", F.floor(F.col("score") / width))
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = steps.groupBy("bucket").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"))  # as many rows as buckets of scores
    bases = totals.select(
        "bucket",
        F.coalesce(F.sum("bp").over(above), F.lit(0.0)).alias("base_p"),
        F.coalesce(F.sum("bn").over(above), F.lit(0.0)).alias("base_n"),
        F.sum("bp").over(every).alias("all_p"),
        F.sum("bn").over(every).alias("all_n"),
    )
    down = Window.partitionBy("bucket").orderBy(F.desc("score"))
    cumulative = (
        steps.join(bases, "bucket")
        .withColumns({"tp": F.col("base_p") + F.sum("p").over(down), "seen": F.col("base_n") + F.sum("n").over(down)})
        .where((F.col("all_p") > 0) & (F.col("all_p") < F.col("all_n")))
    )
    own_negatives = F.col("n") - F.col("p")
    # a positive wins against the negatives below it, and half against those of its own score
    below = (F.col("all_n") - F.col("all_p")) - (F.col("seen") - F.col("tp"))
    rate = F.col("all_p") / F.col("all_n")
    return cumulative.groupBy("all_p", "all_n").agg(F.sum(F.col("p") * (below + own_negatives / 2)).alias("wins"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("hits")).select(
        (F.col("wins") / (F.col("all_p") * (F.col("all_n") - F.col("all_p")))).alias("roc_auc"),
        (F.col("hits") / F.col("all_p")).alias("average_precision"),
        F.greatest(rate, 1 - rate).alias("majority_accuracy"),
        rate.alias("positive_rate"),
    )


def imbalance(labels: DataFrame, by: list[str]) -> DataFrame:
    """Weight of a positive: negatives over positives (over one, if there is none)."""
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return labels.groupBy(*by).agg(pos.alias("n_positive"), neg.alias("n_negative"), (neg / F.greatest(pos, F.lit(1))).alias("weight"))


def over_seeds(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation of a metric over seeds; nulls are left out."""
    return runs.groupBy(*by).agg(F.count(value).alias("n_runs"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))


def box_features(boxes: Column, n: int, width: float, height: float) -> Column:
    """The last `n` boxes that exist as (cx, cy, w, h) of the image and their first differences (0 in
    the first row); null for shorter windows."""
    some = F.filter(boxes, lambda b: b.isNotNull())
    last = F.slice(some, -n, n)
    flat = F.transform(
        last,
        lambda b: F.array((b["x1"] + b["x2"]) / (2 * width), (b["y1"] + b["y2"]) / (2 * height), (b["x2"] - b["x1"]) / width, (b["y2"] - b["y1"]) / height),
    )
    before = F.concat(F.slice(flat, 1, 1), F.slice(flat, 1, n - 1))
    return F.when(F.size(some) >= n, F.zip_with(flat, before, lambda a, b: F.concat(a, F.zip_with(a, b, lambda p, q: p - q))))
