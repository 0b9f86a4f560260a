"""The consumer's side: the sample index, single samples, and what a model may read of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import select_part


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sample(samples: DataFrame, sample_id: str) -> Row:
    """One sample by its id; an unknown id is an error. The filter reaches the Parquet scan."""
    found = samples.where(F.col("sample_id") == sample_id).head()
    if found is None:
        raise KeyError(sample_id)
    return found


def population(index: DataFrame, samples: DataFrame) -> Iterator[Row]:
    """Samples of the index's rows in the order of their ids, fetched partition by partition."""
    return samples.join(index.select("sample_id"), "sample_id", "left_semi").orderBy("sample_id").toLocalIterator()


def sample_id(sequence: Column, pedestrian: Column, start_us: Column) -> Column:
    return F.concat_ws("_", sequence, pedestrian, F.floor(start_us / 1000 + 0.5).cast("string"))


def positions(frames: Column, end: Column, part: str = "observed", seen_from: str = "world", kind: str = "float") -> Column:
    """Positions of one part of a sample as rows of three floats, in the world or (`ego`) as the vehicle sees them; by default nothing after the window.

    Models read floats; sums over them need `kind="double"`, or their last digits go."""
    place = {"world": "position", "ego": "position_ego_rel"}[seen_from]
    return F.transform(select_part(frames, end, part), lambda f: F.transform(f[place], lambda v: v.cast(kind)))


def frame_times(frames: Column, end: Column, part: str = "observed") -> Column:
    """Times of the same frames as `positions` gives."""
    return F.transform(select_part(frames, end, part), lambda f: f["ts"])


def boxes(camera_frames: Column) -> Column:
    """The track's box in every image of the window, null where it is out of sight (and never zeros, which would claim a place)."""
    return F.transform(camera_frames, lambda f: f["bbox"])


def window_bounds(samples: DataFrame) -> DataFrame:
    """sample_id, start and end of the observed window in seconds."""
    return samples.select("sample_id", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))


def media_paths(root: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat_ws("/", F.lit(root.rstrip("/")), n))


def index_row(samples: DataFrame) -> DataFrame:
    """Nested samples to flat index rows (the labels map to three columns)."""
    at = lambda h: F.element_at("labels_by_horizon", h)
    nested = [c for c, kind in samples.dtypes if kind.startswith(("array", "map", "struct"))]
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c, kind in samples.dtypes if kind.startswith("array")]
    return samples.select(*[c for c in samples.columns if c not in nested], *sizes, at("1.0").alias("intent_h1_0s"), at("1.5").alias("intent_h1_5s"), at("2.0").alias("intent_h2_0s"))
