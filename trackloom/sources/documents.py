"""Scans of nested JSON documents: clips, annotations, poses, polygons, detections, tracks.

All take an explicit schema or one declared here; a file that does not follow it fails the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Version tags of documents, and the shapes that go with them.
DETECTIONS, TRAJECTORY, ACTION, SAMPLE = "detections/v1", "trajectory/v0.2", "action/v0.3", "sample/v0.2"
POSES = "timestamps array<double>, poses array<array<array<double>>>"
POLYGONS = "features array<struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:map<string,string>>>"
BOXES = "array<struct<class:string,uuid:string,occlusion:string,geometry:struct<type:string,coordinates:array<array<double>>>,location_3d:array<double>,size_lwh:array<double>,quat_wxyz:array<double>>>"
CACHE = "schema string, meta map<string,string>, images map<string,array<array<double>>>"
FRAME = "struct<timestamp:string,position_world:array<double>,in_observation:boolean,num_lidar_points:int,kalman_confidence:double,tracking_method:string>"
TRACK = f"schema string, sequence_id string, pedestrian_id string, is_in_gold_standard boolean, keyframe_timestamp string, frames array<{FRAME}>"


def json_documents(spark: SparkSession, path: str, schema: str, version: str | None = None, lines: bool = False) -> DataFrame:
    """One row a document, with its file name; documents of another version tag are an error. A file is one document, or has one on each of its `lines`."""
    rows = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    if version is None:
        return rows
    wrong = F.raise_error(F.concat(F.lit(f"not {version}: "), F.col("file_name"))).cast("string")
    return rows.withColumn("schema", F.when(F.col("schema") == version, F.col("schema")).otherwise(wrong))


def working_set(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The clips of a list document in its order; `most` keeps the first ones."""
    listed = spark.read.schema("sequences array<struct<seq_id:string>>").option("multiLine", True).json(path)
    rows = listed.select(F.posexplode("sequences").alias("place", "s")).select("place", F.col("s.seq_id").alias("sequence_id"))
    return rows if most is None else rows.where(F.col("place") < most)


def key_of_file(name: Column) -> tuple[Column, Column]:
    """sequence and pedestrian of `{sequence}_{pedestrian}.json`."""
    pattern = r"^([^_]*)_(.*?)(\.json)?$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def boxes_3d(objects: DataFrame, kind: str = "Pedestrian") -> DataFrame:
    """Annotated boxes of a class that have a place in space. Input: sequence_id, object."""
    o = F.col("object")
    return objects.where((o["class"] == kind) & o["location_3d"].isNotNull()).select("sequence_id", o["uuid"].alias("uuid"), o["occlusion"].alias("occlusion"), o["location_3d"].alias("center"), o["size_lwh"].alias("size_lwh"), o["quat_wxyz"].alias("quat_wxyz"))


def boxes_2d(objects: DataFrame, kind: str = "Pedestrian") -> DataFrame:
    """Image boxes from two or more marked points; objects without a place in space stay."""
    o, points = F.col("object"), F.col("object.geometry.coordinates")
    axis = lambda f, i: f(F.transform(points, lambda p: F.element_at(p, i)))
    marked = objects.where((o["class"] == kind) & (o["geometry"]["type"] == "MultiPoint") & (F.size(points) >= 2))
    return marked.select("sequence_id", o["uuid"].alias("uuid"), axis(F.array_min, 1).alias("x1"), axis(F.array_min, 2).alias("y1"), axis(F.array_max, 1).alias("x2"), axis(F.array_max, 2).alias("y2"))


def poses(documents: DataFrame) -> DataFrame:
    """One row for each pose: ts, and the 4x4 matrix by rows."""
    zipped = documents.select("sequence_id", F.inline(F.arrays_zip("timestamps", "poses")))
    return zipped.select("sequence_id", F.col("timestamps").alias("ts"), F.flatten("poses").alias("pose"))


def road_polygons(documents: DataFrame) -> DataFrame:
    """The outer rings of all features of a clip, as arrays of points."""
    ring = lambda f: F.transform(F.element_at(f["geometry"]["coordinates"], 1), lambda p: F.struct(F.element_at(p, 1).alias("x"), F.element_at(p, 2).alias("y")))
    return documents.select("sequence_id", F.transform("features", ring).alias("rings"))


def detections(cache: DataFrame, least: float = 0.0) -> DataFrame:
    """Detections of a per-image cache with at least a score. Input: sequence_id, images."""
    each = cache.select("sequence_id", F.explode("images").alias("image", "boxes")).select("sequence_id", "image", F.explode("boxes").alias("b"))
    at = lambda i: F.element_at("b", i)
    return each.where(at(5) >= least).select("sequence_id", "image", *[at(i + 1).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2", "score"))])


def with_all_images(images: DataFrame, found: DataFrame) -> DataFrame:
    """Every image with its detections; an image without any has an empty array."""
    own = found.groupBy("sequence_id", "image").agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "x2", "y2", "score"))).alias("boxes"))
    empty = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>")
    return images.join(own, ["sequence_id", "image"], "left").withColumn("boxes", F.coalesce("boxes", empty))


def tier(flag: Column) -> Column:
    """Documents without the flag are gold."""
    return F.when(F.coalesce(flag, F.lit(True)), "gold").otherwise("silver")


def track_frames(tracks: DataFrame) -> DataFrame:
    """One row for each frame of track documents."""
    each = tracks.select("sequence_id", "pedestrian_id", tier(F.col("is_in_gold_standard")).alias("tier"), F.posexplode("frames").alias("place", "f"))
    p = F.col("f.position_world")
    return each.select(
        "sequence_id", "pedestrian_id", "tier", "place",
        F.unix_micros(F.to_timestamp("f.timestamp")).alias("t_us"),
        *[F.element_at(p, i + 1).alias(n) for i, n in enumerate("xyz")],
        F.col("f.in_observation").alias("observed"), F.col("f.num_lidar_points").alias("points"), F.col("f.kalman_confidence").alias("confidence"), F.col("f.tracking_method").alias("method"),
    )


def track_documents(frames: DataFrame) -> DataFrame:
    """Frames back to one document a track, with counts; the observed share is null for an empty one."""
    frame = F.struct(F.col("t_us"), F.array("x", "y", "z").alias("position_world"), F.col("observed").alias("in_observation"), F.col("points").alias("num_lidar_points"), F.col("confidence").alias("kalman_confidence"), F.col("method").alias("tracking_method"))
    own = frames.groupBy("sequence_id", "pedestrian_id", "tier").agg(F.sort_array(F.collect_list(frame)).alias("frames"), F.count("*").alias("n_frames"), F.count_if("observed").alias("n_observed"))
    return own.withColumn("n_coasted", F.col("n_frames") - F.col("n_observed")).withColumn("observed_fraction", F.try_divide("n_observed", "n_frames"))
