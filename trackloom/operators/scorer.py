"""A scorer of windows: boosted trees on box features, weighted by class, chosen on the validation split, over several seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, written
from .scoring import ranking_metrics


def prepared(windows: DataFrame) -> DataFrame:
    """split, label, features (vector), weight of windows (split, label, features: array of arrays, null where a window is too short).

    Positives weigh as many times more as there are fewer of them in the training split; windows without features are left out.
    """
    rows = windows.where("features is not null and label is not null").select("split", F.col("label").cast("double").alias("label"), array_to_vector(F.flatten("features")).alias("features"))
    n = rows.where("split = 'train'").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    return rows.withColumn("weight", F.when(F.col("label") == 1, n["n"] / max(n["p"], 1)).otherwise(1.0))


def _measured(model, rows: DataFrame) -> tuple[float | None, float | None]:
    scored = model.transform(rows).select(F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
    got = ranking_metrics(scored).first()
    return (got["roc_auc"], got["average_precision"]) if got else (None, None)


def runs(windows: DataFrame, seeds: Sequence[int] = (0, 1, 2), depths: Sequence[int] = (2, 4), rounds: int = 10) -> DataFrame:
    """One row a seed: the depth that ranks the validation split best (the smaller of equals), its AUC there, and AUC and average precision on the test split.

    Training and scoring run on Spark; the loop is over seeds and depths alone. The test split is looked at once a seed, by the chosen model.
    """
    rows = written(prepared(windows), "windows")
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    out = []
    for seed in seeds:
        tried = []
        for depth in depths:
            model = GBTClassifier(maxDepth=depth, maxIter=rounds, subsamplingRate=0.7, seed=seed, weightCol="weight").fit(train)
            tried.append((_measured(model, val)[0] or 0.0, -depth, model))
        auc, depth, model = max(tried, key=lambda x: x[:2])
        out.append((seed, -depth, auc, *_measured(model, test)))
    release(rows)
    return windows.sparkSession.createDataFrame(out, "seed int, depth int, val_auc double, roc_auc double, average_precision double")
