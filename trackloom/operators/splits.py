"""The split deal: sequences to train, val and test, balanced in two masses, best of several seeds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import SPLITS

SAMPLE_WEIGHT = 0.25


def deal(masses: pd.DataFrame, seed: int, ratios: dict[str, float] = SPLITS) -> pd.DataFrame:
    """One deal. Strata of two and more, one, and no event windows, in this order; shuffled inside; each
    sequence goes where the filling (event windows, and a quarter of samples) stays smallest."""
    names, target = list(ratios), np.array(list(ratios.values()))
    if len(names) != 3 or abs(target.sum() - 1) > 1e-9:
        raise ValueError("three ratios that add up to 1 are needed")
    events, weight = masses["n_tte"].to_numpy(float), np.maximum(masses["n_samples"].to_numpy(float), 1)
    all_events, all_weight = max(events.sum(), 1.0), weight.sum()
    fill, got = np.zeros((3, 2)), np.empty(len(masses), dtype=object)
    rng = np.random.default_rng(seed)
    stratum = np.minimum(masses["n_tte"].to_numpy(), 2)
    for kind in (2, 1, 0):
        members = np.flatnonzero(stratum == kind)
        members = members[np.argsort(masses["seq"].to_numpy()[members])]
        rng.shuffle(members)
        for i in members:
            then = fill + [events[i], weight[i]]
            cost = then[:, 0] / (target * all_events) + SAMPLE_WEIGHT * then[:, 1] / (target * all_weight)
            k = int(np.argmin(cost))
            fill[k] = then[k]
            got[i] = names[k]
    return pd.DataFrame({"seq": masses["seq"].to_numpy(), "split": got})


def imbalance(masses: pd.DataFrame, dealt: pd.DataFrame, ratios: dict[str, float] = SPLITS) -> float:
    own = masses.merge(dealt, on="seq").groupby("split")[["n_samples", "n_tte"]].sum().reindex(list(ratios), fill_value=0)
    share = own / own.sum().replace(0, 1)
    return float(np.abs(share.sub(pd.Series(ratios), axis=0)).to_numpy().sum())


def best_deal(masses: DataFrame, seeds: Sequence[int] = range(64), ratios: dict[str, float] = SPLITS) -> DataFrame:
    """seq, split, seed, score of the best seed (the first of equals).

    One row for each sequence of the working set is the input of every seed: a dimension table, sent
    to one task a seed; the deal itself depends on its own order and is not divided further.
    """
    each = masses.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        seed = int(own["seed"].iloc[0])
        dealt = deal(own.drop(columns="seed"), seed, ratios)
        return dealt.assign(seed=seed, score=round(imbalance(own, dealt, ratios), 9))

    all_deals = each.groupBy("seed").applyInPandas(run, "seq long, split string, seed int, score double")
    best = all_deals.groupBy("seed").agg(F.min("score").alias("score")).agg(F.min(F.struct("score", "seed")).alias("b")).select(F.col("b.seed").alias("seed"))
    return all_deals.join(F.broadcast(best), "seed").select("seq", "split", "seed", "score")


def working_set(listed: DataFrame, sampled: DataFrame) -> DataFrame:
    """All sequences that are listed or have samples, each once."""
    return listed.select("seq").union(sampled.select("seq")).distinct()


def inherit(wanted: DataFrame, frozen: DataFrame) -> DataFrame:
    """The sequences with their frozen split; `fresh` ones are not in the frozen map and have none yet."""
    return wanted.select("seq").join(frozen.select("seq", "split"), "seq", "left").withColumn("fresh", F.col("split").isNull())
