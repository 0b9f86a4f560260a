"""Scans as files, the candidate pool, claims, boxes from motion, replacement of tables, the scorer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom import sensed
from trackloom.operators import boxes, pool, scorer
from trackloom.sinks import writers
from trackloom.sources import npy

SCAN = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "u1")])


def save_scans(folder):
    for second in range(5):
        rows = np.zeros(3 + second, dtype=SCAN)
        rows["x"], rows["intensity"] = second, 200
        np.save(folder / f"000001_quebec_2024-01-02T03:04:0{second}.250000Z.npy", rows)


def test_npy_reads_structured_files(spark, tmp_path):
    save_scans(tmp_path)
    npy.register(spark)
    scans = spark.read.format("npy").load(str(tmp_path))
    assert scans.dtypes == [("path", "string"), ("t_us", "bigint"), ("x", "float"), ("y", "float"), ("z", "float"), ("intensity", "smallint")]
    assert scans.rdd.getNumPartitions() == 5 and scans.count() == 25
    got = {r["t_us"]: (r["n"], r["x"], r["i"]) for r in scans.groupBy("t_us").agg(F.count("*").alias("n"), F.max("x").alias("x"), F.max("intensity").alias("i")).collect()}
    assert got == {1_704_164_640_250_000 + 1_000_000 * s: (3 + s, s, 200) for s in range(5)}
    one = spark.read.format("npy").schema("x float").load(str(tmp_path / "000001_quebec_2024-01-02T03:04:02.250000Z.npy"))
    assert one.count() == 5 and one.columns == ["x"]
    assert spark.read.format("npy").option("pattern", "none*").schema("x float").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="no .npy file"):
        spark.read.format("npy").option("pattern", "none*").load(str(tmp_path))


def test_npy_does_not_open_files_out_of_range(spark, tmp_path):
    save_scans(tmp_path)
    (tmp_path / "000001_quebec_2024-01-02T03:04:09.000000Z.npy").write_bytes(b"this is no array")
    (tmp_path / "zz_notime.npy").write_bytes(b"neither is this")
    npy.register(spark)
    near = spark.read.format("npy").load(str(tmp_path)).where(F.col("t_us").between(1_704_164_641_000_000, 1_704_164_643_250_000) & (F.col("y") == 0))
    assert near.rdd.getNumPartitions() == 3 and near.count() == 4 + 5 + 6
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan npy" in plan and ">=" not in plan and "<=" not in plan  # the reader has taken all comparisons
    assert spark.read.format("npy").load(str(tmp_path)).where("t_us < 5").count() == 0  # no file passes
    with pytest.raises(Exception, match="(?i)magic|pickle|header"):
        spark.read.format("npy").load(str(tmp_path)).count()


def test_npy_filters_records(spark, tmp_path):
    """Radar: one file a clip, its records have times of their own; other conditions stay with Spark."""
    rows = np.zeros(1000, dtype=[("ts_ns", "<i8"), ("speed", "<f8")])
    rows["ts_ns"], rows["speed"] = np.arange(1000) * 10, np.arange(1000) % 7
    np.save(tmp_path / "radar.npy", rows)
    npy.register(spark)
    own = spark.read.format("npy").load(str(tmp_path)).where("ts_ns >= 500 and ts_ns <= 900 and (speed = 3 or ts_ns = 510)")
    assert sorted(r["ts_ns"] for r in own.collect()) == [t for t in range(500, 901, 10) if (t // 10) % 7 == 3 or t == 510]
    assert own.where("t_us is null").count() == own.count()


def test_written_scans_are_the_same_twice(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 4 as scan", "1700000000000000L + (id % 4) * 1500000 as t_us", "cast(id as double) as x", "cast(-id as double) as y").repartition(3)
    for _ in range(2):
        assert {(r["scan"], r["n"]) for r in npy.write_scans(rows, str(tmp_path)).collect()} == {(str(k), 10) for k in range(4)}
    npy.register(spark)
    back = spark.read.format("npy").load(str(tmp_path))
    assert back.count() == 40 and back.agg(F.sum("x"), F.sum("y")).first() == (780.0, -780.0) and len(list(tmp_path.iterdir())) == 4


def test_replacement_is_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "table")
    read = lambda: sorted(r["v"] for r in spark.read.parquet(path).collect())
    writers.replace(spark.createDataFrame([(1,), (2,)], "v long"), path)
    with pytest.raises(FileExistsError):
        writers.replace(spark.createDataFrame([(9,)], "v long"), path)
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken row"):
        writers.replace(broken, path, force=True)
    assert read() == [1, 2] and [p.name for p in tmp_path.iterdir()] == ["table"]
    writers.restamp(spark, path, lambda df: df.union(df.select(F.col("v") + 10)))  # reads what it replaces
    assert read() == [1, 2, 11, 12] and [p.name for p in tmp_path.iterdir()] == ["table"]
    with pytest.raises(Exception, match="broken row"):
        writers.restamp(spark, path, lambda df: df.select(F.raise_error(F.lit("broken row")).cast("long").alias("v")))
    assert read() == [1, 2, 11, 12]


def test_scans_share_images_and_the_detector_sees_each_once(spark):
    scans = spark.createDataFrame([(1, k, t) for k, t in ((1, 0.0), (2, 0.1), (3, 0.25), (4, 0.9), (5, 0.35))], "seq long, scan long, t double")
    images = spark.createDataFrame([(1, "a", 0.05), (1, "b", 0.3), (1, "c", 5.0), (2, "d", 0.0)], "seq long, image string, t double")
    paired = pool.pairs(scans, images, 0.1)
    assert sorted((r["scan"], r["image"]) for r in paired.collect()) == [(1, "a"), (2, "a"), (3, "b"), (5, "b")]
    cached = spark.createDataFrame([(1, "a"), (1, "c")], "seq long, image string")
    assert [tuple(r) for r in pool.misses(paired, cached).collect()] == [(1, "b")]
    asked = []
    known = spark.createDataFrame([(1, "a", 7, 0.0, 0.0, 10.0, 10.0, 0.9), (1, "a", 8, 0.0, 0.0, 10.0, 10.0, 0.1), (1, "c", 9, 0.0, 0.0, 10.0, 10.0, 0.9)], "seq long, image string, box long, x1 double, y1 double, x2 double, y2 double, score double")

    def detector(missing):
        asked.append(missing.count())
        return missing.select("seq", "image", F.lit(5).cast("long").alias("box"), *[F.lit(v).alias(n) for n, v in (("x1", 0.0), ("y1", 0.0), ("x2", 10.0), ("y2", 10.0), ("score", 0.5))])

    found = pool.detected(paired, cached, known, detector, least=0.2)
    assert sorted((r["image"], r["box"]) for r in found.collect()) == [("a", 7), ("b", 5)] and asked == [1]
    points = spark.createDataFrame([(s, x, 0.0, 1.0, 5.0, 5.0) for s in (1, 3) for x in (10.0, 10.2, 10.4)] + [(2, 10.0, 0.0, 1.0, 5.0, 5.0)], "scan long, x double, y double, z double, u double, v double")
    got = {r["scan"]: (r["box"], r["x"], r["n_points"]) for r in pool.candidates(paired, found, points).collect()}
    assert got == {1: (7, 10.2, 3), 2: (None, None, None), 3: (5, 10.2, 3), 5: (None, None, None)}
    turned = spark.createDataFrame([(1, k, [0.0, -1.0, 0.0, 100.0, 1.0, 0.0, 0.0, 200.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for k in (1, 2)], "seq long, scan long, pose array<double>")
    world = {r["scan"]: (r["x"], r["y"], r["z"]) for r in pool.in_world(pool.candidates(paired, found, points), turned).collect()}
    assert world == {1: (100.0, 210.2, 1.0), 2: (None, None, None)}


def test_claims_of_coasted_frames(spark):
    """A candidate where an anchored track coasts is claimed; one scan later, farther away or in another sequence it is not."""
    tracks = spark.createDataFrame([(1, 0, 0.0, 0.0, True), (1, 100, 1.0, 0.0, False)], "seq long, t_us long, x double, y double, observed boolean")
    own = spark.createDataFrame([(1, 100, 10, 1.3, 0.0), (1, 100, 11, 2.0, 0.0), (1, 200, 12, 1.0, 0.0), (2, 100, 13, 1.0, 0.0), (1, 0, 14, 0.0, 0.5), (1, 300, None, None, None)], "seq long, t_us long, key long, x double, y double")
    left = pool.residual(own, pool.claims(tracks), 0.6)
    assert sorted((r["seq"], r["t_us"], r["key"] or 0) for r in left.collect()) == [(1, 0, 0), (1, 100, 11), (1, 200, 12), (1, 300, 0), (2, 100, 13)]


def made_boxes(spark, rows):
    frames = spark.createDataFrame(rows, "track long, frame long, t double, x double, y double, z double")
    sizes = spark.createDataFrame([(k, 0.8, 0.6, 1.7) for k in {r[0] for r in rows}], "track long, length double, width double, height double")
    return {r["frame"]: r for r in boxes.from_motion(frames, sizes).collect()}


def test_boxes_take_the_heading_of_the_nearest_moving_frame(spark):
    walk = [(0.0, 0.0), (0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (2.0, 2.0), (2.0, 2.0), (2.0, 2.0)]
    got = made_boxes(spark, [(1, i, float(i), x, y, 0.5) for i, (x, y) in enumerate(walk)] + [(2, 100 + i, float(i), 5.0, 5.0, 0.0) for i in range(3)] + [(3, 200, 0.0, 1.0, 1.0, 1.0)])
    velocity = np.gradient(np.array(walk), np.arange(len(walk)), axis=0)
    moving = np.hypot(*velocity.T) >= 0.3
    for i in range(len(walk)):
        source = min(np.flatnonzero(moving), key=lambda j: (abs(j - i), j))
        assert got[i]["yaw"] == pytest.approx(math.atan2(velocity[source][1], velocity[source][0])) and got[i]["yaw_source"] == ("velocity" if moving[i] else "static_fill")
    assert {(got[k]["yaw"], got[k]["yaw_source"]) for k in (100, 101, 102, 200)} == {(0.0, "undefined")}
    assert (got[3]["x"], got[3]["y"], got[3]["z"], got[3]["length"], got[3]["height"]) == (1.0, 0.0, 0.5, 0.8, 1.7)


def test_velocities_on_uneven_times(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 10, 30))
    place = rng.normal(size=(30, 3))
    frames = spark.createDataFrame([(1, i, float(a), *map(float, p)) for i, (a, p) in enumerate(zip(t, place, strict=True))], "track long, frame long, t double, x double, y double, z double")
    got = sorted(boxes.velocities(frames).collect(), key=lambda r: r["frame"])
    assert np.allclose([[r["vx"], r["vy"], r["vz"]] for r in got], np.gradient(place, t, axis=0))
    still = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 0.0), (1, 1, 1.0, 5.0, 0.0, 0.0)], "track long, frame long, t double, x double, y double, z double")
    assert {r["vx"] for r in boxes.velocities(still).collect()} == {0.0}  # time stands still


def test_scorer_learns_what_can_be_learned(spark):
    """One feature tells the label, and positives are rare; without features or with one class nothing breaks."""
    rng = np.random.default_rng(2)
    rows = [(["train", "val", "test"][min(2, i // 200)], int(a > 0.85), [[float(a), float(b)]] if i % 50 else None) for i, (a, b) in enumerate(rng.random((500, 2)))]
    windows = spark.createDataFrame(rows, "split string, label int, features array<array<double>>")
    ready = scorer.prepared(windows)
    weights = {r["label"]: r["weight"] for r in ready.select("label", "weight").distinct().collect()}
    train = [r for r in rows if r[0] == "train" and r[2]]
    assert ready.count() == 490 and weights[0.0] == 1 and weights[1.0] == pytest.approx(sum(1 - r[1] for r in train) / sum(r[1] for r in train))
    got = scorer.runs(windows, seeds=(0, 1), depths=(1, 2), rounds=3).collect()
    assert [r["seed"] for r in got] == [0, 1] and all(r["roc_auc"] > 0.97 and r["average_precision"] > 0.9 and r["depth"] in (1, 2) for r in got)


def test_scorer_query(spark):
    got = sensed.scorer_runs(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 3 and all(0.4 < r["roc_auc"] <= 1 and 0 < r["average_precision"] <= 1 for r in got)
