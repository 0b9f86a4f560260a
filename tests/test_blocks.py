"""Blocks of samples, what consumers read of them, manifests and reports of earlier stages."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trackloom.operators import actions, blocks
from trackloom.sinks import writers
from trackloom.sources import documents, index, reports


@pytest.fixture(scope="module")
def sampled(spark):
    return spark.createDataFrame([("a", 1, 10, 2.0, 4.0), ("b", 1, 11, 50.0, 51.0)], "sample_id string, seq long, track long, start double, end double")


def test_trajectory_in_both_frames(spark, sampled):
    """A window of two seconds, one second ahead; the vehicle stands at (1, 0) and looks along y."""
    rows = [(10, i, i / 2, float(i), 2.0, 0.5, i != 5, 3, 0.9) for i in range(14)]
    frames = spark.createDataFrame(rows, "track long, frame long, t double, x double, y double, z double, observed boolean, points int, confidence double")
    turned = [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    poses = spark.createDataFrame([("a", turned), ("b", turned)], "sample_id string, pose array<double>")
    block = blocks.trajectory(sampled, frames, poses, ahead=1.0)
    got = {r["sample_id"]: r["frames"] for r in block.collect()}
    assert set(got) == {"a"} and [f["ts"] for f in got["a"]] == [2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0]
    assert got["a"][0]["position"] == [4.0, 2.0, 0.5] and got["a"][0]["position_ego_rel"] == [2.0, -3.0, 0.5]
    whole = blocks.assembled(sampled, block)
    parts = whole.where("sample_id = 'a'").select(*[F.size(index.frame_times(F.col("frames"), F.col("end"), p)).alias(p) for p in ("observed", "future", "all")], index.positions(F.col("frames"), F.col("end"), "future").alias("places"), index.positions(F.col("frames"), F.col("end"), "observed", "ego").alias("ego")).first()
    assert (parts["observed"], parts["future"], parts["all"], len(parts["places"])) == (5, 2, 7, 2) and parts["ego"][0] == [2.0, -3.0, 0.5]
    assert whole.where("sample_id = 'b'").first()["frames"] is None
    assert [tuple(r) for r in index.window_bounds(sampled).orderBy("start").collect()] == [("a", 2.0, 4.0), ("b", 50.0, 51.0)]


def test_media_keep_images_without_a_box(spark, sampled):
    records = spark.createDataFrame([(1, 2.0, "camera", "i1"), (1, 3.0, "lidar", "s1"), (1, 4.00005, "camera", "i2"), (1, 4.1, "camera", "late"), (2, 3.0, "camera", "other")], "seq long, t double, sensor string, path string")
    seen = spark.createDataFrame([(10, 2.0, [1.0, 2.0, 3.0, 4.0]), (99, 4.00005, [0.0] * 4)], "track long, t double, bbox array<double>")
    got = {r["sample_id"]: r for r in blocks.media(sampled, records, seen).collect()}
    assert [(f["path"], f["bbox"]) for f in got["a"]["camera_frames"]] == [("i1", [1.0, 2.0, 3.0, 4.0]), ("i2", None)] and [f["path"] for f in got["a"]["lidar_scans"]] == ["s1"]
    assert got["b"]["camera_frames"] == [] and got["b"]["lidar_scans"] == []
    both = blocks.media(sampled, records, seen).select("sample_id", index.boxes(F.col("camera_frames")).alias("b"))
    assert both.where("sample_id = 'a'").first()["b"] == [[1.0, 2.0, 3.0, 4.0], None]


def test_context_and_metadata(spark, sampled):
    speed = spark.createDataFrame([(1, 1.0, 5.0), (1, 3.0, 7.0), (2, 2.0, 9.0)], "seq long, t double, value double")
    turns = spark.createDataFrame([], "seq long, t double, value string")
    got = {r["sample_id"]: r for r in blocks.context(sampled, {"ego_speed": speed, "turn": turns}).collect()}
    assert (got["a"]["ego_speed"], got["b"]["ego_speed"], got["a"]["turn"]) == (5.0, 7.0, None)  # of equals the earlier
    frames = spark.createDataFrame([(1, 10, 5.0), (1, 11, 5.0), (1, 12, 9.0)], "seq long, track long, x double")
    places = spark.createDataFrame([(1, "Gdansk", "2024-01-02")], "seq long, location string, collection_date string")
    meta = {r["sample_id"]: r for r in blocks.metadata(sampled, frames, F.col("x"), places).collect()}
    assert meta["a"]["num_pedestrians_in_scene"] == 3 and (meta["a"]["is_key_pedestrian"], meta["b"]["is_key_pedestrian"]) == (True, False) and meta["b"]["location"] == "Gdansk"


def test_actions_join(spark):
    tracks = spark.createDataFrame([(1, 10), (1, 11)], "seq long, track long")
    records = spark.createDataFrame([(1, 10, "determined"), (1, 12, "determined")], "seq long, track long, status string")
    assert sorted((r["track"], r["status"], r["missing"]) for r in actions.with_actions(tracks, records).collect()) == [(10, "determined", False), (11, None, True)]
    assert [r["track"] for r in actions.only_for(records, tracks.union(tracks)).collect()] == [10]
    frames = spark.createDataFrame([(1, 10, 1, 0.0, True, 5, "anchor"), (1, 10, 2, 1.0, True, -1, "forward"), (1, 10, 3, 2.0, False, -1, "forward")], "seq long, track long, frame long, t double, observed boolean, points int, method string")
    known = [F.lit(False), F.lit(True)]
    assert actions.label_actions(frames, *known).first()["n_real"] == 1  # by method
    assert actions.label_actions(frames.drop("method"), *known).first()["n_real"] == 1  # by points: the anchor has some here
    assert actions.label_actions(frames.where("frame = 1"), *known).first()["status"] == "undetermined"


def test_manifests_and_reports(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps({"dropped": [{"seq": "000001", "ped": "a", "why": "x"}] * 2, "kept": []}, indent=1))
    (tmp_path / "stitch.json").write_text(json.dumps({"groups": [{"seq_id": "000001", "primary_id": "b", "primary_is_gold": False, "member_ids": ["a", "b"], "links": []}]}, indent=1))
    (tmp_path / "run.json").write_text(json.dumps({"n_sequences": 2, "per_sequence": [{"seq_id": "000001", "n_pool_frames": 190}, {"seq_id": "000002", "n_pool_frames": 0}]}))
    (tmp_path / "quality.csv").write_text("seq,ped,tier,flags\n000001,a,silver,SHORT\n000001,b,gold,\n")
    for s, t in (("000001", "2024-01-02T03:04:05.5Z"), ("000002", "2024-01-02T03:04:06Z")):
        (tmp_path / "single_frames" / s).mkdir(parents=True)
        (tmp_path / "single_frames" / s / "info.json").write_text(json.dumps({"keyframe_time": t, "location": "x"}, indent=2))
    at = lambda name: str(tmp_path / name)
    assert [tuple(r) for r in reports.cut_keys(spark, at("cut.json")).collect()] == [("000001", "a")]
    assert sorted((r["chain"], r["key"], r["place"], r["primary"], r["primary_gold"]) for r in reports.stitch_members(spark, at("stitch.json")).collect()) == [(0, "a", 0, False, False), (0, "b", 1, True, False)]
    assert {r["sequence_id"]: r["n_pool"] for r in reports.pool_frames(spark, at("run.json")).collect()} == {"000001": 190, "000002": 0}
    assert [r["ped"] for r in reports.silver_quality(spark, at("quality.csv")).collect()] == ["a"]
    assert {r["sequence_id"]: r["t"] for r in reports.keyframes(spark, at("single_frames/*/info.json")).collect()} == {"000001": 1_704_164_645.5, "000002": 1_704_164_646.0}
    for empty in (reports.cut_keys, reports.stitch_members, reports.pool_frames):
        assert empty(spark, at("none.json")).count() == 0
    found = reports.provenance(spark, str(tmp_path), {"tracks": ("run.json", ("n_sequences", "config")), "absent": ("no.json", ("x",))})
    assert found == {"tracks": {"n_sequences": 2, "config": None}}


def test_detection_cache_comes_back(spark, tmp_path):
    """Images without boxes stay in the cache; writing one sequence again leaves the others."""
    boxes = "array<struct<x1:double,y1:double,x2:double,y2:double,score:double>>"
    images = spark.createDataFrame([("s1", "i1", [(0.0, 1.0, 2.0, 3.0, 0.9), (0.0, 1.0, 2.0, 3.0, 0.05)]), ("s1", "i2", []), ("s2", "i1", [])], f"sequence_id string, image string, boxes {boxes}")
    path = str(tmp_path / "cache")
    writers.detections(images, path)
    writers.detections(images.where("sequence_id = 's2'"), path)
    cache = spark.read.parquet(path)
    assert {r["sequence_id"]: sorted(r["images"]) for r in cache.collect()} == {"s1": ["i1", "i2"], "s2": ["i1"]}
    found = documents.detections(cache, 0.1).collect()
    assert [(r["image"], r["score"]) for r in found] == [("i1", 0.9)] and math.isclose(found[0]["x2"], 2.0)


def test_positions_keep_their_digits_as_doubles(spark):
    """Values of more digits than a float holds: sums of doubles stay exact."""
    frames = F.array(F.struct(F.lit(1.0).alias("ts"), F.array(F.lit(122.795003), F.lit(0.0), F.lit(0.0)).alias("position")))
    row = spark.range(1).select(*[index.positions(frames, F.lit(2.0), kind=kind)[0][0].cast("double").alias(kind) for kind in ("float", "double")]).first()
    assert row["double"] == 122.795003 and row["float"] != 122.795003
