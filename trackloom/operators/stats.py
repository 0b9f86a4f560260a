"""One counting path for the sample index: selection, composition, funnels, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

# Horizons and their columns, tiers, splits with their shares.
HORIZON_COLUMNS = {1.0: "h1_0", 1.5: "h1_5", 2.0: "h2_0"}
TIERS = ("gold", "silver")
SPLITS = {"train": 0.7, "val": 0.1, "test": 0.2}


def _all_splits() -> WindowSpec:
    """Over a result of three rows, one for each split."""
    return Window.partitionBy()


def horizon_column(horizon: float) -> str:
    if horizon not in HORIZON_COLUMNS:
        raise ValueError(f"unknown horizon: {horizon}")
    return HORIZON_COLUMNS[horizon]


def select(index: DataFrame, split: str | None = None, tier: str | None = None, crossing: bool | None = None, horizon: float = 2.0) -> DataFrame:
    """Rows that meet all conditions that are given; a null split meets none."""
    if tier is not None and tier not in TIERS:
        raise ValueError(f"unknown tier: {tier}")
    if split is not None:
        index = index.where(F.col("split") == split)
    if tier is not None:
        index = index.where(F.col("tier") == tier)
    if crossing is not None:
        index = index.where(F.col(horizon_column(horizon)) == crossing)
    return index


def _counts(horizon: float) -> list[Column]:
    hit = horizon_column(horizon)
    return [
        F.count("*").alias("n_rows"),
        F.count_distinct("seq", "pedestrian").alias("n_pedestrians"),
        F.count_if(hit).alias("n_crossing"),
        F.avg(F.col(hit).cast("int")).alias("ratio"),
    ]


def composition(index: DataFrame, horizon: float = 2.0) -> DataFrame:
    """By tier and split; rows without a split are left out."""
    return index.where("split is not null").groupBy("tier", "split").agg(*_counts(horizon))


def composition_sets(index: DataFrame, horizon: float = 2.0) -> DataFrame:
    """Totals, tiers, and tiers by split in one pass. `level`: 0 tier and split, 1 tier, 3 all."""
    both = [F.col("tier"), F.col("split")]
    found = index.groupingSets([both, [F.col("tier")], []], *both).agg(F.grouping_id().cast("int").alias("level"), *_counts(horizon))
    return found.where("level > 0 or split is not null")


#: Levels of the composition: tier and split, tier, all.
_LEVELS = (0, 1, 3)


def _begun(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """Adds for each level whether the row is the first of its key (one without nulls) in its tier and split, in its tier, in all."""
    before = F.lag(F.struct("tier", "split")).over(Window.partitionBy(*key).orderBy("tier", "split"))
    marked = rows.withColumn("before", before)
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    whole = F.col("before").isNull()
    tier = whole | ~F.col("tier").eqNullSafe(F.col("before.tier"))
    split = tier | ~F.col("split").eqNullSafe(F.col("before.split"))
    return marked.withColumns({f"{name}{i}": known & first for i, first in zip(_LEVELS, (split, tier, whole), strict=True)}).drop("before")


def composition_at(index: DataFrame, horizons: Sequence[float] = tuple(HORIZON_COLUMNS)) -> DataFrame:
    """Totals (level 3), tiers (1) and tiers by split (0) at every horizon, as rows: horizon (text), level, tier, split, samples, pedestrians,
    sequences, crossers, crossing_ratio.

    Distinct pedestrians and sequences are counted by what is new in order: sorted by tier and split, a pedestrian's row that begins a set of a
    level counts once there. One exchange and one sort (which may spill) serve all levels, no set multiplies rows, and only tiers by split are
    turned into sets and horizons. Rows without a split count in totals and tiers.
    """
    hits = {str(h): horizon_column(h) for h in horizons}
    rows = _begun(index.select("seq", "pedestrian", "tier", "split", *hits.values()), ["seq", "pedestrian"], "p")
    own = rows.groupBy("seq", "tier", "split").agg(F.count("*").alias("n"), *[F.count_if(f"p{i}").alias(f"p{i}") for i in _LEVELS], *[F.count_if(c).alias(c) for c in hits.values()])
    few = _begun(own, ["seq"], "s").groupBy("tier", "split").agg(*[F.sum(c).alias(c) for c in ("n", *[f"p{i}" for i in _LEVELS], *hits.values())], *[F.count_if(f"s{i}").alias(f"s{i}") for i in _LEVELS])
    both = [F.col("tier"), F.col("split")]
    at = lambda kind: F.when(F.grouping_id() == 0, F.sum(f"{kind}0")).when(F.grouping_id() == 1, F.sum(f"{kind}1")).otherwise(F.sum(f"{kind}3"))
    sets = few.groupingSets([both, [F.col("tier")], []], *both).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("n").alias("samples"), at("p").alias("pedestrians"), at("s").alias("sequences"), *[F.sum(c).alias(c) for c in hits.values()]
    )
    kept = sets.where("(level > 0 or split is not null) and samples is not null")
    each = kept.withColumn("h", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("crossers")) for h, c in hits.items()])))
    return each.select("h.horizon", "level", "tier", "split", "samples", "pedestrians", "sequences", "h.crossers", (F.col("h.crossers") / F.col("samples")).alias("crossing_ratio"))


def shares(counts: DataFrame, count: str = "n") -> DataFrame:
    """Counts (a row for each reason: few) with their share of the total."""
    return counts.withColumn("share", F.try_divide(F.col(count).cast("double"), F.sum(count).over(Window.partitionBy())))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """Name and size of each stage; the stages are aggregates, not collected."""
    out = None
    for name, df in stages.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def masses(sequences: DataFrame, index: DataFrame) -> DataFrame:
    """Samples and event windows for every sequence of the working set, 0 where it has none."""
    own = index.groupBy("seq").agg(F.count("*").alias("n_samples"), F.count_if("tte").alias("n_tte"))
    return sequences.select("seq").join(own, "seq", "left").fillna(0, ["n_samples", "n_tte"])


def stamp(index: DataFrame, split_map: DataFrame) -> DataFrame:
    """The index with its splits; a sequence without one is an error, not a guess."""
    joined = index.drop("split").join(split_map, "seq", "left")
    checked = F.coalesce("split", F.raise_error(F.concat(F.lit("no split for sequence "), F.col("seq").cast("string"))).cast("string"))
    return joined.withColumn("split", checked)


def split_summary(index: DataFrame) -> DataFrame:
    """All three splits, also empty ones: sequences, rows, event windows, share, crossing at each horizon."""
    spark = index.sparkSession
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    own = index.where("split is not null").groupBy("split").agg(
        F.count_distinct("seq").alias("n_sequences"),
        F.count("*").alias("n_rows"),
        F.count_if("tte").alias("n_tte"),
        *[F.count_if(c).alias(f"n_{c}") for c in HORIZON_COLUMNS.values()],
    )
    filled = names.join(own, "split", "left").na.fill(0)
    return filled.withColumn("share", F.try_divide(F.col("n_rows").cast("double"), F.sum("n_rows").over(_all_splits())))


def balance(masses: DataFrame, split_map: DataFrame) -> DataFrame:
    """How far the splits' shares of both masses are from their targets, summed."""
    spark = masses.sparkSession
    target = spark.createDataFrame(list(SPLITS.items()), "split string, target double")
    own = masses.join(split_map, "seq").groupBy("split").agg(F.sum("n_samples").alias("s"), F.sum("n_tte").alias("t"))
    rows = target.join(own, "split", "left").na.fill(0)
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.sum(c).over(_all_splits())), F.lit(0.0))
    off = F.abs(share("s") - F.col("target")) + F.abs(share("t") - F.col("target"))
    return rows.select(off.alias("off")).agg(F.sum("off").alias("score"))
