"""Hand-made cases of the operators over frames."""

import math

import pytest
from pyspark.sql import functions as F

from trackloom.operators import quality, temporal, windows

SCHEMA = "seq long, track long, frame long, t double, observed boolean, points int, x double, confidence double"


def frames(spark, rows):
    """(t, observed, x) of one track, or full tuples."""
    full = [(0, 1, i, float(r[0]), bool(r[1]), 5, float(r[2]), 0.9) if len(r) == 3 else r for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def observed(spark, flags):
    return frames(spark, [(i, f, 0) for i, f in enumerate(flags)])


def test_coast_runs(spark):
    runs = temporal.coast_runs(observed(spark, [1, 0, 0, 1, 0, 1, 0, 0, 0])).orderBy("t_start").collect()
    assert [r["n_frames"] for r in runs] == [2, 1, 3]
    assert [r["internal"] for r in runs] == [True, True, False]


def test_bridged_gap(spark):
    row = temporal.longest_bridged(observed(spark, [1, 0, 0, 1, 0, 1, 0, 0, 0])).first()
    assert (row["gap_frames"], row["gap_seconds"]) == (2, 1.0)
    tie = temporal.longest_bridged(frames(spark, [(0, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (6, 0, 0), (7, 1, 0)])).first()
    assert (tie["gap_frames"], tie["gap_seconds"]) == (2, 1.0)


def test_gradient(spark):
    rows = temporal.gradient(frames(spark, [(0, 1, 0), (1, 1, 1), (3, 1, 9)])).orderBy("frame").collect()
    assert [r["velocity"] for r in rows] == pytest.approx([1, 2, 4])
    assert temporal.gradient(frames(spark, [(0, 1, 5)])).first()["velocity"] is None


@pytest.mark.parametrize(("moving", "yaw", "want"), [("FTFFT", [0, 1, 0, 0, 2], [1, 1, 1, 2, 2]), ("TFT", [1, 0, 2], [1, 1, 2]), ("FF", [1, 2], [0, 0])])
def test_nearest_fill(spark, moving, yaw, want):
    rows = [(0, 1, i, float(i), m == "T", 5, float(y), 0.9) for i, (m, y) in enumerate(zip(moving, yaw, strict=True))]
    got = temporal.nearest_fill(frames(spark, rows), F.col("x"), F.col("observed")).orderBy("frame").collect()
    assert [r["value"] for r in got] == want
    if "T" not in moving:
        assert {r["origin"] for r in got} == {"undefined"}


def test_interpolation_is_clamped(spark):
    right = frames(spark, [(0, 1, 0), (1, 1, 10), (3, 1, 30)])
    left = frames(spark, [(2, 1, 0), (-1, 1, 0), (5, 1, 0), (1, 1, 0)])
    got = temporal.interpolate(left, right, F.col("x")).orderBy("frame").collect()
    assert [r["value"] for r in got] == pytest.approx([20, 0, 30, 10])


def test_nearest_within_tolerance(spark):
    images = frames(spark, [(9.950, 1, 1), (10.060, 1, 2)])
    scan = frames(spark, [(10.0, 1, 0)])
    assert temporal.asof_nearest(scan, images, F.col("x"), 0.055).first()["match_t"] == 9.950
    assert temporal.asof_nearest(scan, images.where("x = 2"), F.col("x"), 0.055).count() == 0
    tie = frames(spark, [(9.0, 1, 1), (11.0, 1, 2)])
    assert temporal.asof_nearest(scan, tie, F.col("x"), 2.0).first()["match_value"] == 1


def test_array_and_join_forms_agree(spark):
    right = frames(spark, [(0.5, 1, 3), (2.5, 1, 7), (4.0, 1, 1)])
    left = frames(spark, [(i / 3, 1, 0) for i in range(15)])
    joined = {r["frame"]: r["match_t"] for r in temporal.asof_nearest(left, right, F.col("x"), 100.0).collect()}
    times = F.array(*[F.lit(t) for t in (0.5, 2.5, 4.0)])
    nearest = F.array_min(F.transform(times, lambda s: F.struct(F.abs(s - F.col("t")).alias("d"), s.alias("s"))))["s"]
    assert joined == {r["frame"]: r["n"] for r in left.select("frame", nearest.alias("n")).collect()}


def test_event_windows_must_fit(spark):
    rows = [(0, 1, i, i / 10, True, 5, 9.0 if i == 16 else 0.0, 0.9) for i in range(101)]
    got = windows.event_windows(frames(spark, rows), F.col("x") > 5).collect()
    fits = [r for r in got if r["skip_reason"] is None]
    assert len(got) == 3 and len(fits) == 1
    assert (fits[0]["start"], fits[0]["end"]) == pytest.approx((0.1, 0.6))
    assert {r["skip_reason"] for r in got if r not in fits} == {"window_outside_track"}


def test_short_track_has_no_comparison_window(spark):
    short = windows.best_observed_window(frames(spark, [(0, 1, 0), (0.4, 1, 0)]), F.col("x")).first()
    assert (short["start"], short["skip_reason"]) == (None, "window_outside_track")
    exact = windows.best_observed_window(frames(spark, [(0, 1, 0), (0.49995, 1, 0)]), F.col("x")).first()
    assert exact["skip_reason"] is None and exact["fraction"] == 1.0
    coasted = windows.best_observed_window(frames(spark, [(0, 1, 0), (0.2, 0, 0), (0.4, 0, 0), (0.6, 0, 0), (0.8, 0, 0), (1.0, 1, 0)]), F.col("x")).first()
    assert coasted["skip_reason"] == "comparison_window_unobserved"


def test_intents_and_confidence(spark):
    schema = "track long, window int, horizon double, end double, onset_t double, onset_observed boolean, fraction double, road_distance double"
    rows = [(1, 0, 1.5, 10.0, 11.5, False, 0.9, 5.0), (2, 0, 1.5, 10.0, 99.0, True, 0.9, 0.5)]
    a, b = windows.intents(spark.createDataFrame(rows, schema)).orderBy("track").collect()
    assert a["labels_by_horizon"] == {"1.0": "not_crossing", "1.5": "crossing", "2.0": "crossing"}
    assert (a["intent"], a["confidence"]) == ("crossing", pytest.approx(0.54))
    assert (b["intent"], b["confidence"]) == ("not_crossing", pytest.approx(0.63))


def test_leak_guard(spark):
    rows = frames(spark, [(9.9, 1, 0), (10.0, 1, 0), (10.1, 1, 0)])
    w = spark.createDataFrame([(1, 0, 9.5, 10.0)], "track long, window long, start double, end double")
    assert windows.parts(w, rows).first()[2:] == (2, 1, 3)
    arrays = rows.agg(F.sort_array(F.collect_list(F.struct(F.col("t").alias("ts")))).alias("f"))
    sizes = arrays.select(*[F.size(windows.select_part(F.col("f"), F.lit(10.0), p)).alias(p) for p in ("observed", "future", "all")]).first()
    assert tuple(sizes) == (2, 1, 3)
    with pytest.raises(ValueError):
        windows.select_part(F.col("f"), F.lit(1.0), "past")


def metrics(spark, **changed):
    base = dict(n_measured=10, coverage=1.0, duration=10.0, median_points=10, median_confidence=0.9, max_speed=1.0) | changed
    row = spark.createDataFrame([tuple(base.values())], "n_measured long, coverage double, duration double, median_points int, median_confidence double, max_speed double")
    found = row.withColumn("found", quality.flags()).withColumn("tier", quality.tier(F.col("found"))).withColumn("flags", F.array_join("found", "|"))
    return found.withColumn("reasons", quality.cut_reasons()).first()


def test_flags_tiers_and_cuts(spark):
    empty = metrics(spark, n_measured=0, coverage=0.0, duration=0.0, median_points=0, median_confidence=0.0, max_speed=0.0)
    assert empty["found"] == ["EMPTY", "SHORT", "SPARSE_LIFT", "LOW_CONF"] and empty["tier"] == "bad"
    assert metrics(spark, duration=1.0)["tier"] == "good"
    assert metrics(spark, coverage=0.4)["tier"] == "marginal"
    assert metrics(spark, duration=1.0, max_speed=6.0)["reasons"] == ["jitter", "bad_tier", "fast"]


def test_metrics_count_only_real_measurements(spark):
    rows = [(0, 1, i, float(i), i != 2, -1 if i in (0, 2) else 4 + i, 0.0, 0.5) for i in range(4)]
    row = quality.track_metrics(frames(spark, rows)).first()
    assert (row["n_frames"], row["n_observed"], row["n_measured"], row["median_points"], row["longest_coast"]) == (4, 3, 2, 6, 1)


def test_accounting(spark, sf):
    from trackloom.plans.adapters import frames as adapted

    rows = adapted(spark, sf)
    proposals = windows.event_windows(rows, F.col("x") > 150, length=3.0)
    assert windows.skip_histogram(proposals).agg(F.sum("n")).first()[0] == proposals.count()
    onset = {r["track"]: r["onset_t"] for r in temporal.first_true(rows, F.col("x") > 150).collect()}
    for r in proposals.collect():
        assert math.isclose(r["end"] + r["horizon"], onset[r["track"]]) and r["end"] < onset[r["track"]]


def test_row_order_does_not_matter(spark, sf):
    from trackloom.plans.adapters import frames as adapted

    rows = adapted(spark, sf)
    mixed = rows.orderBy(F.xxhash64("frame")).repartition(3)
    for f in (temporal.coast_runs, temporal.gradient, quality.track_quality):
        assert sorted(map(str, f(rows).collect())) == sorted(map(str, f(mixed).collect()))


def test_a_long_track_takes_seconds(spark):
    """Filling, as-of joins and interpolation grow with the track's length, not with its square."""
    import time

    n = 200_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("seq"), F.lit(1).cast("long").alias("track"), F.col("id").alias("frame"), (F.col("id") / 9).alias("t"), (F.col("id") % 1000 == 7).alias("observed"), F.lit(5).alias("points"), (F.col("id") / 9).alias("x"), F.lit(0.9).alias("confidence"))
    known, others = rows.where("observed"), rows.where("not observed")
    began = time.monotonic()
    filled = temporal.nearest_fill(rows, F.col("x"), F.col("observed")).agg(F.count("*"), F.count_if(F.col("origin") == "own")).first()
    assert tuple(filled) == (n, n // 1000)
    nearest = temporal.asof_nearest(others, known, F.col("x")).agg(F.count("*"), F.max("gap")).first()
    assert nearest[0] == n - n // 1000 and 55 < nearest[1] < 111
    inner = temporal.interpolate(others, known, F.col("x")).join(others.select("frame", "t"), "frame").where("t > 1 and t < 22000")
    assert inner.agg(F.max(F.abs(F.col("value") - F.col("t")))).first()[0] < 1e-6
    window = windows.best_observed_window(rows, F.col("x"), length=1.0, least=0.1).first()
    assert window["skip_reason"] is None and window["fraction"] >= 0.1
    assert time.monotonic() - began < 40


def test_frames_of_equal_time_are_in_order_of_their_number(spark):
    rows = [(0, 1, 5, 1.0, True, 3, 9.0, 0.5), (0, 1, 4, 1.0, False, -1, 7.0, 0.5), (0, 1, 3, 0.0, True, 3, 0.0, 0.5)]
    for order in (rows, rows[::-1]):
        got = temporal.nearest_fill(frames(spark, order), F.col("x"), F.col("frame") == 4).orderBy("frame").collect()
        assert [r["origin"] for r in got] == ["filled", "own", "filled"]
        assert [(r["n_frames"], r["internal"]) for r in temporal.coast_runs(frames(spark, order)).collect()] == [(1, True)]


def test_nearest_of_any_type_with_its_gap(spark):
    signal = frames(spark, [(0, 1, 350), (10, 1, 10)])
    asked = frames(spark, [(4, 1, 0), (6, 1, 0), (99, 1, 0)])
    got = temporal.asof_nearest(asked, signal, F.when(F.col("x") > 180, "left").otherwise("right")).orderBy("frame").collect()
    assert [(r["match_value"], r["gap"]) for r in got] == [("left", 4.0), ("right", 4.0), ("right", 89.0)]
    none = temporal.asof_nearest(asked, signal.where("false"), F.col("x")).collect()
    assert len(none) == 3 and all(r["match_value"] is None and r["gap"] is None for r in none)


def test_speed_is_that_of_all_coordinates(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0.0, True, 5, 0.9, 0.0, 0.0, 0.0), (1, 1, 1, 2.0, True, 5, 0.9, 2.0, 3.0, 6.0), (1, 1, 2, 2.0, True, 5, 0.9, 99.0, 0.0, 0.0)], "seq long, track long, frame long, t double, observed boolean, points int, confidence double, x double, y double, z double")
    assert [(r["frame"], r["speed"]) for r in temporal.speeds(rows).collect()] == [(1, 3.5)]  # time stands still in the last step
    assert quality.track_metrics(rows).first()["max_speed"] == 3.5
    path = temporal.paths(rows.where("frame < 2")).first()
    assert (path["n_observed"], path["path"], path["longest_step"]) == (2, 7.0, 7.0)


def test_an_anchor_is_observed_but_no_measurement(spark):
    """Five observed frames of six, one of them an anchor; confidences of all five count."""
    rows = [(0, 1, i, float(i), i != 3, -1 if i in (2, 3) else 9, 0.0, [0.1, 0.2, 0.9, 0.0, 0.9, 0.9][i]) for i in range(6)]
    row = quality.track_metrics(frames(spark, rows)).first()
    assert (row["n_observed"], row["n_measured"], row["observed_fraction"], row["coverage"]) == (5, 4, pytest.approx(5 / 6), pytest.approx(4 / 6))
    assert row["median_confidence"] == 0.9  # 0.55 without the anchor
    found = quality.track_quality(frames(spark, rows), quality.Thresholds(coverage=0.7)).first()
    assert found["flags"] == "LOW_COVERAGE" and found["tier"] == "marginal"


def test_flags_compare_rounded_metrics(spark):
    assert metrics(spark, coverage=0.4996)["found"] == [] and metrics(spark, coverage=0.4994)["found"] == ["LOW_COVERAGE"]
    assert metrics(spark, duration=2.996)["found"] == [] and metrics(spark, max_speed=3.504)["found"] == []
    assert metrics(spark, max_speed=3.506)["found"] == ["JITTER"]


def test_windows_of_crossers_and_others(spark):
    rows = frames(spark, [(0, 1, i, i / 10, True, 5, 1.0, 0.9) for i in range(60)] + [(0, 2, i, i / 10, True, 5, float(i), 0.9) for i in range(60)] + [(0, 3, 0, 0.0, True, 5, 1.0, 0.9)])
    actions = spark.createDataFrame([(1, True, 3.0, False, 0.0, 5.9), (2, False, None, None, 0.0, 5.9), (3, False, None, None, 0.0, 0.0), (4, None, None, None, 0.0, 0.0)], "track long, crosses boolean, crossing_t double, crossing_observed boolean, t0 double, t1 double")
    got = sorted((r["track"], r["kind"], r["horizon"], None if r["end"] is None else round(r["end"], 6), r["skip_reason"]) for r in windows.propose(rows, actions, F.abs(F.col("x") - 30)).collect() if r["track"] != 1)
    assert got == [(2, "closest_approach", None, 3.0, None), (3, "closest_approach", None, None, "window_outside_track")]
    before = sorted((r["horizon"], round(r["end"], 6)) for r in windows.propose(rows, actions, F.col("x")).where("track = 1").collect())
    assert before == [(1.0, 2.0), (1.5, 1.5), (2.0, 1.0)]
