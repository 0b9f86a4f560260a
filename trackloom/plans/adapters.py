"""The driver's tables in the shapes that the operators take.

frames     one row for each frame of a track, from `events`: a user is a track, fifty users in a row are a
           sequence (so a sequence stays as large as it is while tables grow), a day stands for a second, an
           error is a frame without observation, a signup an anchor (observed, but no measurement)
samples    one row for each sample of an index, from `lineitem`
verdicts   answers of reviewers, from `documents` and `labels`
points     coordinates, from `embeddings`
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import micros

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, k = F.col("event_type") != "error", F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 50).alias("seq"),
        F.col("user_id").alias("track"),
        F.col("event_id").alias("frame"),
        micros(F.col("ts")).alias("t_us"),
        (micros(F.col("ts")) / F.lit(float(DAY_US))).alias("t"),
        seen.alias("observed"),
        F.when(seen & (F.col("event_type") != "signup"), k.cast("int")).otherwise(-1).alias("points"),
        F.col("value").alias("x"),
        k.cast("double").alias("y"),
        (F.col("value") / 8).alias("z"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        F.col("event_type").alias("kind"),
    )


FRAMES_SQL = """frames AS (
  SELECT user_id // 50 AS seq, user_id AS track, event_id AS frame, epoch_us(ts) AS t_us, epoch_us(ts) / 86400000000.0::DOUBLE AS t,
    event_type <> 'error' AS observed,
    CASE WHEN event_type NOT IN ('error', 'signup') THEN CAST(props->>'k' AS INT) ELSE -1 END AS points,
    value AS x, CAST(props->>'k' AS DOUBLE) AS y, value / 8 AS z, least(value / 100, 1.0) AS confidence, event_type AS kind
  FROM events)"""


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a sequence's sensors: views are scans, clicks and purchases images."""
    own = frames(spark, sf_dir).where("kind in ('view', 'click', 'purchase')")
    return own.select("seq", "t", F.when(F.col("kind") == "view", "lidar").otherwise("camera").alias("sensor"))


SENSORS_SQL = "sensors AS (SELECT seq, t, CASE WHEN kind = 'view' THEN 'lidar' ELSE 'camera' END AS sensor FROM frames WHERE kind IN ('view', 'click', 'purchase'))"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tier gold unless the return flag is N, crossing by quantity, splits 7/1/2 by sequence; sequences ending in 9 of 100 have none."""
    seq = F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        seq.alias("seq"),
        F.col("l_orderkey").alias("pedestrian"),
        F.col("l_linenumber").alias("window"),
        F.when(F.col("l_returnflag") == "N", "silver").otherwise("gold").alias("tier"),
        F.when(seq % 50 == 49, F.lit(None)).when(seq % 10 < 7, "train").when(seq % 10 == 7, "val").otherwise("test").alias("split"),
        (F.col("l_quantity") > 40).alias("h1_0"),
        (F.col("l_quantity") > 35).alias("h1_5"),
        (F.col("l_quantity") > 30).alias("h2_0"),
        (F.col("l_linestatus") == "F").alias("tte"),
    )


SAMPLES_SQL = """samples AS (
  SELECT l_suppkey AS seq, l_orderkey AS pedestrian, l_linenumber AS "window",
    CASE WHEN l_returnflag = 'N' THEN 'silver' ELSE 'gold' END AS tier,
    CASE WHEN l_suppkey % 50 = 49 THEN NULL WHEN l_suppkey % 10 < 7 THEN 'train' WHEN l_suppkey % 10 = 7 THEN 'val' ELSE 'test' END AS split,
    l_quantity > 40 AS h1_0, l_quantity > 35 AS h1_5, l_quantity > 30 AS h2_0, l_linestatus = 'F' AS tte
  FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.element_at("embedding", i).cast("double") * 10
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


POINTS_SQL = """points AS (
  SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"""
