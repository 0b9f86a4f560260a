"""Manifests and run reports of earlier stages as tables; a file that is not there gives no rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import iso_to_micros
from .files import _csv

_CUT = "dropped array<struct<seq:string,ped:string>>"
_STITCH = "groups array<struct<seq_id:string,primary_id:string,primary_is_gold:boolean,member_ids:array<string>>>"
_POOL = "per_sequence array<struct<seq_id:string,n_pool_frames:long>>"


def there(spark: SparkSession, path: str) -> bool:
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(own)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path) if there(spark, path) else spark.createDataFrame([], schema)


def keyframes(spark: SparkSession, infos: str) -> DataFrame:
    """sequence_id and t of the keyframe, from the `info.json` of each sequence's folder (a pattern over them)."""
    rows = spark.read.schema("keyframe_time string").option("multiLine", True).json(infos)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(folder.alias("sequence_id"), (iso_to_micros(F.col("keyframe_time")) / F.lit(1e6)).alias("t"))


def cut_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct sequence_id, pedestrian_id that the cut dropped."""
    return _json(spark, path, _CUT).select(F.explode("dropped").alias("d")).select(F.col("d.seq").alias("sequence_id"), F.col("d.ped").alias("pedestrian_id")).distinct()


def stitch_members(spark: SparkSession, path: str) -> DataFrame:
    """sequence_id, chain, key, place, primary, primary_gold: what `stitching.resolve` takes."""
    groups = _json(spark, path, _STITCH).select(F.posexplode("groups").alias("chain", "g"))
    rows = groups.select("chain", "g.*").select("chain", F.col("seq_id").alias("sequence_id"), "primary_id", F.col("primary_is_gold").alias("primary_gold"), F.posexplode("member_ids").alias("place", "key"))
    return rows.withColumn("primary", F.col("key") == F.col("primary_id")).drop("primary_id")


def silver_quality(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the quality table that are not gold; columns as text."""
    return _csv(spark, path).where(F.lower(F.trim("tier")) == "silver")


def pool_frames(spark: SparkSession, path: str) -> DataFrame:
    """sequence_id and number of pool frames, from the report of the run that built the pool."""
    return _json(spark, path, _POOL).select(F.explode("per_sequence").alias("s")).select(F.col("s.seq_id").alias("sequence_id"), F.col("s.n_pool_frames").alias("n_pool"))


def provenance(spark: SparkSession, folder: str, stages: dict[str, tuple[str, tuple[str, ...]]]) -> dict[str, dict]:
    """What each stage says of itself: for `stages` (name -> report's file, keys to take) the keys of the reports that are there.

    A stage without a report is left out, a key that a report has not is null. Reports are small documents of one run each."""
    out = {}
    for name, (file, keys) in stages.items():
        path = f"{folder.rstrip('/')}/{file}"
        if there(spark, path):
            text = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))
            out[name] = {key: text.get(key) for key in keys}
    return out
