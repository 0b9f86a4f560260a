"""Bundles: inputs, manifest, summary, checksums; what renderers say; the vehicle's path."""

import json
import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions.time import short_id
from trackloom.operators import actions, integrity, poses, stats
from trackloom.sinks import bundle

INDEX = "seq long, pedestrian string, tier string, split string, h1_0 boolean, h1_5 boolean, h2_0 boolean"
STAGES = [bundle.Stage("tracking", "{n_sequences} sequences", "{n_tracks} tracks", "{tiers.good:.0%} clean"), bundle.Stage("review", "{n} watched", "{flips} flipped"), bundle.Stage("never", "{a}", "{b}")]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "a", "gold", "train", True, True, True), (1, "a", "gold", "train", False, True, True), (1, "b", "silver", "train", False, False, True), (2, "a", "gold", "test", False, False, False), (3, "c", "silver", None, False, False, False)]
    return spark.createDataFrame(rows, INDEX)


def _made(spark, index, **more):
    skips = spark.createDataFrame([("far", 3), ("dark", 9)], "reason string, n long")
    funnel = stats.funnel({"tracks": spark.range(7), "samples": index})
    stages = {"tracking": {"n_sequences": 3, "n_tracks": 7, "tiers": {"good": 0.5}}, "review": {"n": 4}}
    return bundle.manifest(index, "0.3", funnel, stages, skips, {"commit": "abcdef0123456789", "dirty": True}, "2024-01-02T00:00:00+00:00", **more)


def test_composition_at_every_horizon(spark, index):
    got = {(r["horizon"], r["level"], r["tier"], r["split"]): (r["samples"], r["pedestrians"], r["sequences"], r["crossers"]) for r in stats.composition_at(index).collect()}
    assert got[("1.0", 3, None, None)] == (5, 4, 3, 1) and got[("2.0", 3, None, None)] == (5, 4, 3, 3)
    assert got[("1.5", 1, "gold", None)] == (3, 2, 2, 2) and got[("1.5", 1, "silver", None)] == (2, 2, 2, 0)
    assert got[("2.0", 0, "silver", "train")] == (1, 1, 1, 1) and ("2.0", 0, "silver", None) not in got
    assert stats.composition_at(index.where("seq > 9")).count() == 0  # also no totals


def test_shares(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3)], "reason string, n long")
    assert {r["reason"]: r["share"] for r in stats.shares(rows).collect()} == {"a": 0.25, "b": 0.75}
    assert stats.shares(rows.where("n > 9")).count() == 0
    assert stats.shares(rows.withColumn("n", F.lit(0))).first()["share"] is None


def test_bundle(spark, index, tmp_path):
    made, path = _made(spark, index, licence="text"), str(tmp_path / "bundle")
    assert made["funnel"] == {"tracks": 7, "samples": 5} and set(made["composition"]) == {"1.0", "1.5", "2.0"} and made["licence"] == "text"
    assert [(r["reason"], r["share"]) for r in made["skips"]] == [("dark", 0.75), ("far", 0.25)]
    with pytest.raises(FileNotFoundError, match="gone-1, .*gone-2"):
        bundle.build(spark, path, {"samples": index}, made, STAGES, "2.0", [str(tmp_path), str(tmp_path / "gone-1"), str(tmp_path / "gone-2")])
    assert not (tmp_path / "bundle").exists()
    n = bundle.build(spark, path, {"samples": index}, made, STAGES, "2.0", [str(tmp_path)])
    lines = (tmp_path / "bundle" / bundle.CHECKSUMS).read_text().splitlines()
    assert len(lines) == n and [x[66:] for x in lines] == sorted(x[66:] for x in lines) and {"README.md", "manifest.json"} <= {x[66:] for x in lines}
    assert json.loads((tmp_path / "bundle" / bundle.MANIFEST).read_text()) == json.loads(json.dumps(made))
    text = (tmp_path / "bundle" / bundle.SUMMARY).read_text()
    for line in ("| tracking | 3 sequences | 7 tracks | 50% clean |", "| review | 4 watched | — flipped | — |", "| gold | train | 2 | 1 | 2 | 1.000 |", "| `dark` | 9 | 75% |", "| **total** | 12 |  |", "7 tracks → 5 samples", "`abcdef012345`, with uncommitted changes", "5 samples of 4 pedestrians in 3 sequences."):
        assert line in text, line
    assert "never" not in text
    assert bundle.verify(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        bundle.build(spark, path, {"samples": index}, made, STAGES, "2.0")
    (tmp_path / "bundle" / bundle.SUMMARY).write_text("changed")
    (tmp_path / "bundle" / "more.txt").write_text("x")
    (tmp_path / "bundle" / bundle.MANIFEST).unlink()
    assert sorted(tuple(r) for r in bundle.verify(spark, path).collect()) == [("README.md", "CHANGED"), ("manifest.json", "MISSING"), ("more.txt", "UNLISTED")]
    bundle.build(spark, path, {"samples": index}, made, STAGES, "2.0", force=True)
    assert bundle.verify(spark, path).count() == 0


def test_a_failed_build_leaves_the_old_bundle(spark, index, tmp_path):
    made, path = _made(spark, index), str(tmp_path / "bundle")
    bundle.build(spark, path, {"samples": index}, made, STAGES, "2.0")
    with pytest.raises(Exception, match="broken"):
        bundle.build(spark, path, {"samples": index, "other": index.select(F.raise_error(F.lit("broken")).cast("string").alias("x"))}, made, STAGES, "2.0", force=True)
    assert bundle.verify(spark, path).count() == 0 and [p.name for p in tmp_path.iterdir()] == ["bundle"]


def test_an_empty_bundle_has_a_summary(spark, index, tmp_path):
    made = bundle.manifest(index.where("seq > 9"), "0", stats.funnel({"tracks": spark.range(0)}), {}, spark.createDataFrame([], "reason string, n long"))
    text = bundle.summary(made, STAGES, "2.0")
    assert "No samples." in text and "Nothing was skipped." in text and "`unknown`" in text


def test_revision(tmp_path):
    assert bundle.revision(str(tmp_path)) == {"commit": None, "dirty": None}


def test_large_files_are_hashed_in_steps(spark, tmp_path):
    """A file whose name holds a blank, a sign of URLs and a letter outside ASCII."""
    (tmp_path / "deep er").mkdir()
    for name, size in (("small", 10), ("deep er/lar%ge é", 100_000)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    whole = integrity.file_checksums(spark, str(tmp_path), relative=True)
    steps = integrity.file_checksums(spark, str(tmp_path), relative=True, whole_bytes=1000)
    assert sorted(r["sha256"] for r in whole.collect()) == sorted(r["sha256"] for r in steps.collect()) and steps.count() == 2


def _pose(x, y, turn):
    return [math.cos(turn), -math.sin(turn), 0.0, x, math.sin(turn), math.cos(turn), 0.0, y, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_ego_path_and_ranges(spark):
    rows = spark.createDataFrame([("s", 0.0, _pose(0.0, 0.0, 3.0)), ("s", 2.0, _pose(4.0, 2.0, -3.0)), ("lone", 5.0, _pose(1.0, 1.0, 0.0))], "sequence_id string, ts double, pose array<double>")
    keys = spark.createDataFrame([("s", 0.5), ("lone", 9.0), ("no poses", 1.0)], "sequence_id string, t double")
    path = poses.ego_path(rows, keys)
    got = {r["sequence_id"]: r for r in path.where("keyframe").collect()}
    assert path.where("not keyframe").count() == 3 and set(got) == {"s", "lone"}
    turn = 3.0 + 0.25 * (2 * math.pi - 6.0)  # over the shorter arc
    assert [round(got["s"][c], 9) for c in ("x", "y", "heading_x", "heading_y")] == [1.0, 0.5, round(math.cos(turn), 9), round(math.sin(turn), 9)]
    assert (got["lone"]["x"], got["lone"]["t"]) == (1.0, 9.0)  # constant after the last pose
    frames = spark.createDataFrame([("s", 1, 1, 0.0, 1.0, 3.5, False), ("s", 1, 2, 1.0, 4.0, 4.5, True), ("s", 2, 1, 0.0, 1.0, 3.5, False), ("no poses", 3, 1, 0.0, 1.0, 1.0, True)], "sequence_id string, track long, frame long, t double, x double, y double, anchor boolean")
    ranges = {r["track"]: (r["anchored"], r["range"]) for r in poses.keyframe_ranges(frames, path, F.col("anchor")).collect()}
    assert ranges == {1: (True, pytest.approx(5.0)), 2: (False, pytest.approx(3.0)), 3: (True, None)}


def test_banners_and_short_ids(spark):
    rows = [(1, "ab345678-9", "determined", True, 12.34), (1, "abc", "determined", False, None), (1, "abd", "undetermined", None, None), (2, "abe", "determined", True, 3.0), (1, "abf", "determined", True, 9.96), (1, "x", "determined", True, 1.0), (1, "abg", "determined", None, None)]
    records = spark.createDataFrame(rows, "seq long, track string, status string, crosses boolean, crossing_t double")
    keys = spark.createDataFrame([(1, 10.0)], "seq long, moment double")
    got = {r["track"]: r["banner"] for r in actions.banners(records, keys, "ab").collect()}
    assert got == {"ab345678-9": "ab345678: CROSSES ROAD  t_c=+2.3s", "abc": "abc: no road cross", "abd": "abd: UNDETERMINED (empty track)", "abe": "abe: CROSSES ROAD", "abf": "abf: CROSSES ROAD  t_c=-0.0s", "abg": "abg: no road cross"}
    ids = spark.createDataFrame([("silver000123",), ("0123456789",), ("ab",)], "k string").select(short_id(F.col("k")).alias("s"))
    assert [r["s"] for r in ids.collect()] == ["silver000123", "01234567", "ab"]


def test_composition_counts_keys_once_a_level_without_multiplying_rows(spark):
    """A pedestrian in two tiers and splits counts once a level; keys with nulls are no pedestrians; the plan expands nothing but few rows."""
    rows = [(1, 1, "gold", "train"), (1, 1, "gold", "train"), (1, 1, "gold", "val"), (1, 1, "silver", None), (2, 1, "gold", "train"), (2, None, "gold", "train"), (None, 3, None, "val")]
    index = spark.createDataFrame([(*r, True, False, True) for r in rows], "seq long, pedestrian long, tier string, split string, h1_0 boolean, h1_5 boolean, h2_0 boolean")
    found = stats.composition_at(index, (2.0,))
    assert "gid" not in found._jdf.queryExecution().optimizedPlan().toString().replace("spark_grouping_id", "")  # no expansion for distinct counts
    got = {(r["level"], r["tier"], r["split"]): (r["samples"], r["pedestrians"], r["sequences"]) for r in found.collect()}
    assert got[3, None, None] == (7, 2, 2) and got[1, "gold", None] == (5, 2, 2) and got[1, "silver", None] == (1, 1, 1) and got[1, None, None] == (1, 0, 0)
    assert got[0, "gold", "train"] == (4, 2, 2) and got[0, "gold", "val"] == (1, 1, 1) and got[0, None, "val"] == (1, 0, 0)
