"""Sources and sinks on files made here."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.time import iso_to_micros, micros_to_iso
from trackloom.operators import integrity
from trackloom.sinks import writers
from trackloom.sources import documents, files, index


def test_times(spark):
    rows = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.250000+00:00",), ("x",)], "s string")
    got = [r[0] for r in rows.select(micros_to_iso(iso_to_micros(F.col("s")))).collect()]
    assert got == ["2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.250000+00:00", None]


def test_track_documents(spark, tmp_path):
    frames = [{"timestamp": f"2024-01-01T00:00:0{i}Z", "position_world": [i, 0, 0], "in_observation": i != 1, "num_lidar_points": 3, "kalman_confidence": 0.5, "tracking_method": "lidar"} for i in range(3)]
    doc = {"schema": documents.TRAJECTORY, "sequence_id": "000001", "pedestrian_id": "a", "frames": frames}
    (tmp_path / "000001_a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "_notes.json").write_text("{}")
    tracks = documents.json_documents(spark, str(tmp_path), documents.TRACK, documents.TRAJECTORY)
    assert tracks.count() == 1
    key = tracks.select(*[c.alias(n) for c, n in zip(documents.key_of_file(F.col("file_name")), ("s", "p"), strict=True)]).first()
    assert tuple(key) == ("000001", "a")
    rows = documents.track_frames(tracks)
    assert [(r["observed"], r["tier"]) for r in rows.orderBy("place").collect()] == [(True, "gold"), (False, "gold"), (True, "gold")]
    again = documents.track_documents(rows).first()
    assert (again["n_frames"], again["n_coasted"], len(again["frames"])) == (3, 1, 3)
    (tmp_path / "000002_b.json").write_text(json.dumps(doc | {"schema": "other"}))
    with pytest.raises(Exception, match="not trajectory"):
        documents.json_documents(spark, str(tmp_path), documents.TRACK, documents.TRAJECTORY).collect()


def test_detections(spark):
    cache = spark.createDataFrame([("s", {"i1": [[0.0, 0.0, 1.0, 1.0, 0.9], [0.0, 0.0, 1.0, 1.0, 0.05]], "i2": []})], "sequence_id string, images map<string,array<array<double>>>")
    found = documents.detections(cache, 0.1)
    assert found.count() == 1
    images = spark.createDataFrame([("s", "i1"), ("s", "i2"), ("s", "i3")], "sequence_id string, image string")
    assert sorted((r["image"], len(r["boxes"])) for r in documents.with_all_images(images, found).collect()) == [("i1", 1), ("i2", 0), ("i3", 0)]


def test_annotations_and_polygons(spark):
    schema = f"sequence_id string, objects {documents.BOXES}"
    marked = ("Pedestrian", "u", "None", ("MultiPoint", [[1.0, 5.0], [3.0, 2.0]]), None, None, None)
    placed = ("Pedestrian", "v", "None", ("MultiPoint", [[1.0, 5.0]]), [1.0, 2.0, 3.0], [1.0, 1.0, 1.0], [1.0, 0.0, 0.0, 0.0])
    objects = spark.createDataFrame([("s", [marked, placed])], schema).select("sequence_id", F.explode("objects").alias("object"))
    assert [r["uuid"] for r in documents.boxes_3d(objects).collect()] == ["v"]
    box = documents.boxes_2d(objects).first()
    assert (box["uuid"], box["x1"], box["y1"], box["x2"], box["y2"]) == ("u", 1.0, 2.0, 3.0, 5.0)
    roads = spark.createDataFrame([("s", [(("Polygon", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]]), {"class": "road"})])], f"sequence_id string, {documents.POLYGONS}")
    assert len(documents.road_polygons(roads).first()["rings"][0]) == 3
    moves = spark.createDataFrame([("s", [0.0, 1.0], [[[1.0] * 4] * 4] * 2)], f"sequence_id string, {documents.POSES}")
    assert [len(r["pose"]) for r in documents.poses(moves).collect()] == [16, 16]


def test_sensor_files(spark, tmp_path):
    kind = np.dtype([("x", "f4"), ("y", "f4"), ("z", "f4"), ("timestamp", "i8"), ("intensity", "u1")])
    (tmp_path / "000001_lidar_2024-01-01T00:00:00.5Z.npy").write_bytes(b"x")
    np.save(tmp_path / "cloud.npy", np.ones(7, dtype=kind))
    names = files.listing(spark, str(tmp_path), "000001*").first()
    assert names["t_us"] == 1704067200500000
    assert files.point_clouds(spark, str(tmp_path), "cloud*").agg(F.count("*"), F.sum("x")).first() == (7, 7.0)


def test_worksheets(spark, tmp_path):
    sheet = tmp_path / "crossers.csv"
    sheet.write_bytes("﻿seq,pedestrian_id,human_cross,human_crossing_offset_s,notes\n7, p1 ,Yes,+4.5,ok\n8,p2,,,\n".encode())
    rows = files.crosser_worksheet(spark, str(sheet)).collect()
    assert [tuple(r) for r in rows] == [("000007", "p1", "Yes", "+4.5", "ok")]
    queue = tmp_path / "queue.csv"
    queue.write_text("seq,primary_ped,geo_cross,pv_cross\n7,p1,False,True\n7,p1,False,True\n8,p2,True,True\n")
    assert [tuple(r) for r in files.disputed(spark, str(queue)).collect()] == [("000007", "p1")]
    assert files.disputed(spark, None).count() == 0 and files.signals(spark, None).count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "sequence_id string, v long")
    path = str(tmp_path / "t")
    writers.tracks(rows, path)
    writers.tracks(spark.createDataFrame([("b", 5)], "sequence_id string, v long"), path)
    assert {r["sequence_id"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 5}
    assert writers.new_only(rows, spark.createDataFrame([("a",)], "sequence_id string"), ["sequence_id"]).count() == 1
    writers.restamp(spark, path, lambda df: df.withColumn("v", F.col("v") + 1))
    assert spark.read.parquet(path).agg(F.sum("v")).first()[0] == 8
    assert json.loads(writers.report(rows.agg(F.count("*").alias("n")), {"x": 1}))["counts"] == {"n": 2}
    assert writers.markdown(rows).count("\n") == 3
    sheet = spark.createDataFrame([("s", "1", "", "old"), ("s", "2", "", "")], "seq string, p string, merge_into string, notes string")
    notes = spark.createDataFrame([("s", "1", "9", "new"), ("s", "2", "9", "new")], "seq string, p string, merge_into string, note string")
    got = {r["p"]: (r["merge_into"], r["notes"]) for r in writers.prefilled(sheet, notes, ["seq", "p"]).collect()}
    assert got == {"1": ("9", "old; new"), "2": ("9", "new")}


def test_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "k string, v long")
    path = str(tmp_path / "bundle")
    sums = writers.snapshot({"rows": rows}, path, {"version": "0"})
    assert integrity.verify(sums, integrity.file_checksums(spark, path)).count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.snapshot({"rows": rows}, path, {})


def test_consumer_side(spark):
    samples = spark.createDataFrame([("s1", {"1.0": "a", "1.5": "b", "2.0": "c"}, [1, 2])], "sample_id string, labels_by_horizon map<string,string>, camera array<int>")
    row = index.index_row(samples).first()
    assert (row["n_camera"], row["intent_h1_0s"], row["intent_h2_0s"]) == (2, "a", "c")
    assert index.sample(samples, "s1")["sample_id"] == "s1"
    with pytest.raises(KeyError):
        index.sample(samples, "s2")
    assert [r["sample_id"] for r in index.population(samples, samples)] == ["s1"]
    assert samples.select(index.sample_id(F.lit("7"), F.lit("p"), F.lit(1_500_600))).first()[0] == "7_p_1501"


CANDIDATES = "seq long, t double, x double, y double, z double"


def born_inputs(spark, folder, parts):
    """Candidates with the moment that closes their step (a ninth of a second), one file a part, read one file a micro-batch."""
    for i, rows in enumerate(parts):
        add_part(spark, folder, i, rows)
    return spark.readStream.schema(f"{CANDIDATES}, closes timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def add_part(spark, folder, i, rows):
    df = spark.createDataFrame(rows, CANDIDATES)
    df.withColumn("closes", F.timestamp_micros(((F.col("t") + 1 / 9) * 1e6).cast("long") + F.lit(1_700_000_000_000_000))).coalesce(1).write.parquet(f"{folder}/{i:03d}")


def at(*rows):
    return [(s, t, x, None if x is None else 0.0, None if x is None else 1.0) for s, t, x in rows]


def tracks_of(*frames):
    rows = [tuple(r) for f in frames for r in f.where("not late").drop("late").collect()]
    return sorted((*r[:4], *(round(v, 9) for v in r[4:])) for r in rows)


def batch_births(spark, rows):
    from trackloom.operators.tracking import born_tracks

    return sorted((*r[:4], *(round(v, 9) for v in r[4:])) for r in map(tuple, born_tracks(spark.createDataFrame(rows, CANDIDATES)).collect()))


WALKS = [*at(*[(1, i / 9, 0.0) for i in range(12)], *[(1, i / 9, 40.0 + i / 50) for i in range(20)], *[(1, 12 / 9 + i / 9, None) for i in range(8)], *[(2, i / 9, 5.0) for i in range(12)])]


def test_stream_births_equal_batch(spark, tmp_path):
    """Whatever the files: steps cut across many of them, and files out of time order within the delay; tracks that are still
    active at the end come out as well."""
    import random

    from trackloom.streaming import online

    want = batch_births(spark, WALKS)
    assert len({r[:2] for r in want}) == 3
    rng = random.Random(2)
    ordered = sorted(WALKS, key=lambda r: r[1])
    mixed = rng.sample(WALKS, len(WALKS))
    for name, parts, delay in (("one", [WALKS], "1 second"), ("ordered", [ordered[k : k + 17] for k in range(0, len(WALKS), 17)], "0 seconds"), ("mixed", [mixed[k : k + 19] for k in range(0, len(WALKS), 19)], "10 seconds")):
        got = online.all_born(born_inputs(spark, tmp_path / name, parts), delay=delay)
        assert tracks_of(*got) == want, name
        assert all(f.where("late").count() == 0 for f in got)


def test_stream_births_retire_while_the_stream_runs(spark, tmp_path):
    from trackloom.streaming import online

    rows = at(*[(1, i / 9, 0.0) for i in range(12)], *[(1, 12 / 9 + i / 9, None) for i in range(8)])
    stream = born_inputs(spark, tmp_path / "in", [rows[:12], rows[12:], at((1, 99.0, None))])
    got = online.drained(online.born_stream(stream.withWatermark("closes", "0 seconds")), "test-births")
    assert got.count() == 12


def test_late_candidates_come_out(spark, tmp_path):
    """A candidate of a step that was taken is a row of its own and changes no track."""
    from trackloom.streaming import online

    rows = at(*[(1, i / 9, 0.0) for i in range(12)], *[(1, 12 / 9 + i / 9, None) for i in range(8)])
    stream = born_inputs(spark, tmp_path / "in", [rows, at((1, 50.0, None)), at((1, 2 / 9, 7.0), (1, 3 / 9, None)), at((1, 60.0, None))])
    streamed, rest = online.all_born(stream, delay="0 seconds")
    late = sorted((r["seq"], r["track"], round(r["t"], 6), r["x"]) for r in streamed.where("late").collect())
    assert [(s, k, t, None if x is None or x != x else x) for s, k, t, x in late] == [(1, None, round(2 / 9, 6), 7.0), (1, None, round(3 / 9, 6), None)]
    assert tracks_of(streamed, rest) == batch_births(spark, rows)


def test_births_go_on_after_a_restart(spark, tmp_path):
    """The stream ends in the middle of tracks and of a step; a new one takes over its state and writes the rest."""
    from trackloom.streaming import online

    ordered = sorted(WALKS, key=lambda r: r[1])
    state, out = f"file://{tmp_path}/state", f"file://{tmp_path}/out"
    for k, parts in enumerate((ordered[:25], ordered[25:])):
        add_part(spark, tmp_path / "in", k, parts)
        stream = spark.readStream.schema(f"{CANDIDATES}, closes timestamp").parquet(f"{tmp_path}/in/*")
        got = online.drained(online.born_stream(stream.withWatermark("closes", "1 second")), "restart", state, out)
    assert tracks_of(got, online.finished(spark, state, stream)) == batch_births(spark, WALKS)
