"""Filtering, births, stitching, verdicts, splits, metrics, integrity."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests import plain_tracking as plain
from trackloom import catalog
from trackloom.operators import guarded, integrity, scoring, splits, stats, stitching, tracking, verdicts

M = tracking.Motion()


def test_smoother_confidence():
    t = np.arange(3.0)
    _, c = tracking.smooth(t, np.zeros((3, 2)), np.array([True, True, False]), M)
    assert c[0] == 1 and c[1] == 1 and c[2] == 0
    _, c = tracking.smooth(np.arange(2.0) / 10, np.array([[0.0], [100.0]]), np.array([True, True]), M)
    assert c[1] == pytest.approx(np.exp(-12.5))


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 40), st.floats(-50, 50), st.floats(0.05, 1.0))
def test_stationary_track_stays(n, place, dt):
    x, _ = tracking.smooth(np.arange(n) * dt, np.full((n, 1), place), np.ones(n, dtype=bool), M)
    assert np.allclose(x, place, atol=1e-8)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_many_tracks_are_smoothed_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, rng.integers(1, 9))
    n = int(sizes.sum())
    t, z, seen = np.round(rng.uniform(0, 5, n), 1), rng.normal(size=(n, 3)), rng.random(n) < 0.6
    ends = np.cumsum(sizes)
    for lo, hi in zip(ends - sizes, ends, strict=True):
        t[lo:hi].sort()
    place, confidence = tracking.smooth_all(sizes, t, z, seen, M)
    for lo, hi in zip(ends - sizes, ends, strict=True):
        p, c = plain.smooth(t[lo:hi], z[lo:hi], seen[lo:hi], M)
        assert np.allclose(place[lo:hi], p, atol=1e-9) and np.allclose(confidence[lo:hi], c, atol=1e-9)
    assert tracking.smooth_all(np.zeros(0, dtype=np.int64), t[:0], z[:0], seen[:0], M)[0].shape == (0, 3)


def test_smooth_tracks_of_any_length(spark):
    """Tracks that end within a step of rows, go over several, or have no measurement at all."""
    rng = np.random.default_rng(1)
    rows = [(k, k * 1000 + i, i / 9, bool(k != 3 and rng.random() < 0.7), *map(float, rng.normal(size=3))) for k, n in ((1, 5), (2, 90), (3, 7), (4, 1), (5, 40)) for i in range(n)]
    frames = spark.createDataFrame(rows, "track long, frame long, t double, observed boolean, x double, y double, z double").repartition(3)
    want = {}
    for k in range(1, 6):
        own = [r for r in rows if r[0] == k]
        place, c = plain.smooth(np.array([r[2] for r in own]), np.array([r[4:] for r in own]), np.array([r[3] for r in own]), M)
        want |= {r[1]: (*p, e) for r, p, e in zip(own, place.tolist(), c.tolist(), strict=True)}
    got = {r["frame"]: (r["x"], r["y"], r["z"], r["confidence"]) for r in tracking.smooth_tracks(frames).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    batches = pa.table({"track": [1] * 5 + [2] * 90 + [3] * 7}).to_batches(max_chunksize=8)
    tables = [t.column("track").to_pylist() for t in tracking.whole_groups(iter(batches), "track", rows=10)]
    assert sum(tables, []) == [1] * 5 + [2] * 90 + [3] * 7 and sum(len(set(t)) for t in tables) == 3


def test_pass_stops_after_the_last_miss():
    none = [np.zeros((0, 3))] * 10
    log = tracking.directed_passes(np.arange(10) / 9, none, none, np.array([-1]), np.zeros((1, 3)), M)
    assert len(log["frame"]) == 5 and not log["seen"].any()


def test_anchored_track_goes_both_ways(spark):
    pool = spark.createDataFrame([(1, i / 9, i / 9, 0.0, 0.0, 7) for i in range(11) if i != 8] + [(1, 8 / 9, None, None, None, None), (1, 0.0, 400.0, 0.0, 0.0, 9)] + [(2, 0.0, 1.0, 1.0, 1.0, 3)], "seq long, t double, x double, y double, z double, points int")
    anchors = spark.createDataFrame([(1, "a", 5 / 9 + 0.01, 5 / 9, 0.0, 0.0), (3, "no frames", 0.0, 0.0, 0.0, 0.0)], "seq long, key string, t double, x double, y double, z double")
    got = sorted(tracking.anchored_tracks(pool, anchors).collect(), key=lambda r: r["t"])
    assert [r["method"] for r in got] == ["backward"] * 5 + ["anchor"] + ["forward"] * 5 and {r["key"] for r in got} == {"a"}
    assert [r["observed"] for r in got] == [i != 8 for i in range(11)] and [r["points"] for r in got] == [7] * 5 + [-1] + [7, 7, -1, 7, 7]
    assert got[8]["confidence"] == 0 and np.allclose([r["x"] for r in got], np.arange(11) / 9, atol=0.05)


@pytest.mark.parametrize(("times", "kept"), [((0, 1, 2), False), ((0, 0.3, 0.6, 0.9), False), ((0, 0.3, 0.6, 1.0), True)])
def test_births_need_support_and_time(times, kept):
    births = tracking.Births(M)
    for t in times:
        births.frame(t, np.zeros((1, 3)))
    assert bool(births.rest()) is kept


def test_born_tracks(spark):
    rows = [(1, i / 9, 0.0, 0.0, 0.0) for i in range(12)] + [(1, i / 9, 50.0, 0.0, 0.0) for i in range(12)] + [(1, 12 / 9 + i / 9, None, None, None) for i in range(3)]
    got = tracking.born_tracks(spark.createDataFrame(rows, "seq long, t double, x double, y double, z double"), M)
    assert sorted((r["track"], r["n"], r["o"]) for r in got.groupBy("track").agg(F.count("*").alias("n"), F.count_if("observed").alias("o")).collect()) == [(0, 12, 12), (1, 12, 12)]


def test_birth_query_equals_the_plain_tracker(spark, sf):
    """All rows of the registered query, step by step with one matrix a track."""
    clips = {}
    for r in catalog._stepped(spark, sf).collect():
        clips.setdefault((r["seq"], r["clip"]), {}).setdefault(r["t"], []).append((r["x"], r["y"], r["z"]))
    want = {}
    for clip, steps in clips.items():
        for row in plain.born([(t, [p for p in steps[t] if p[0] is not None]) for t in sorted(steps)], catalog.MOTION):
            want[*clip, *row[:2]] = row[2:]
    got = {(r["seq"], r["clip"], r["track"], r["t"]): (r["observed"], r["x"], r["y"], r["z"], r["confidence"]) for r in tracking.born_tracks(catalog._stepped(spark, sf), catalog.MOTION, by=("seq", "clip")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want) and len(want) > 100


def test_anchored_query_equals_the_plain_tracker(spark, sf):
    rows = catalog._stepped(spark, sf).withColumn("seq", F.col("seq") * 100_000 + F.col("clip")).collect()
    want = {}
    for seq in {r["seq"] for r in rows}:
        steps = {}
        for r in rows:
            if r["seq"] == seq and r["kind"] != "signup":
                own = steps.setdefault(r["t"], [])
                if r["x"] is not None:
                    own.append((r["x"], r["y"], r["z"]))
        times = np.array(sorted(steps))
        found = [np.array(sorted(steps[t])).reshape(-1, 3) for t in times]
        for r in rows:
            if r["seq"] == seq and r["kind"] == "signup" and len(times):
                log = plain.anchored_track(times, found, r["t"], np.array([r["x"], r["y"], r["z"]]), catalog.MOTION)
                place, c = plain.smooth(np.array([e[0] for e in log]), np.array([e[2] for e in log]), np.array([e[1] for e in log]), catalog.MOTION)
                want |= {(seq, r["frame"], round(e[0], 3)): (e[1], *p, k) for e, p, k in zip(log, place.tolist(), c.tolist(), strict=True)}
    got = {(r["seq"], r["key"], r["t"]): (r["observed"], r["x"], r["y"], r["z"], r["confidence"]) for r in catalog.QUERIES["anchored_tracks"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-3) for k in want) and len(want) > 100


def test_a_broken_clip_fails_alone(spark):
    def own(table):
        if 3 in table.column("v").to_pylist():
            raise ZeroDivisionError("three")
        return table.select(["seq", "v"])

    rows = spark.createDataFrame([(i // 4, i) for i in range(12)], "seq long, v long")
    done = guarded.apply(rows, ["seq"], own, "seq long, v long")
    assert sorted(r["v"] for r in done.results.collect()) == list(range(4, 12)) and done.results.columns == ["seq", "v"]
    assert [tuple(r) for r in done.failures.collect()] == [(0, "ZeroDivisionError('three')")]
    assert [tuple(r) for r in guarded.report(done).collect()] == [("ZeroDivisionError('three')", 1)]
    fine = guarded.apply(rows.where("v > 3"), ["seq"], own, "seq long, v long")
    assert fine.failures.count() == 0 and fine.results.count() == 8
    assert guarded.apply(rows.where("false"), ["seq"], own, "seq long, v long").results.count() == 0


ENDS = "seq long, track long, n_measured long, first_t double, first_x double, first_y double, last_t double, last_x double, last_y double, height double, velocity_x double, velocity_y double"


@pytest.mark.parametrize(("start", "x", "y", "height", "accepted"), [(11.0, 1.4, 0.0, 1.7, True), (11.0, 1.4, 0.0, 2.4, False), (12.1, 2.1, 0.0, 1.7, False), (9.6, 0.0, 0.0, 1.7, False), (11.0, 3.1, 0.0, 1.7, False), (11.0, 1.4, 2.5, 1.7, False)])
def test_continuation(spark, start, x, y, height, accepted):
    """The last case is far in y alone."""
    ends = spark.createDataFrame([(0, 1, 9, 0.0, -10.0, 0.0, 10.0, 0.0, 0.0, 1.7, 1.0, 0.0), (0, 2, 9, start, x, y, 20.0, 9.0, 0.0, height, 1.0, 0.0)], ENDS)
    edges = stitching.continuation_edges(ends).collect()
    assert bool(edges) is accepted
    if accepted:
        assert (edges[0]["gap"], edges[0]["residual"]) == pytest.approx((1, 0.4))


def test_overlapping_fragments_are_not_led_back(spark):
    """The second begins 0.2 s before the first ends: the first's last place counts, not where it was then."""
    ends = spark.createDataFrame([(0, 1, 9, 0.0, -10.0, 0.0, 10.0, 0.0, 0.0, 1.7, 10.0, 0.0), (0, 2, 9, 9.8, 0.5, 0.0, 20.0, 9.0, 0.0, 1.7, 1.0, 0.0)], ENDS)
    edge = stitching.continuation_edges(ends).first()
    assert (edge["gap"], edge["residual"]) == (pytest.approx(-0.2), pytest.approx(0.5))  # led back it would be 2.5 and no edge


def test_time_that_stands_still_takes_the_nominal_step():
    z, seen = np.array([[0.0], [1.0], [2.0]]), np.ones(3, dtype=bool)
    same, nominal = tracking.smooth(np.array([0.0, 0.0, 0.0]), z, seen, M), tracking.smooth(np.arange(3) * M.nominal_dt, z, seen, M)
    assert np.allclose(same[0], nominal[0]) and np.allclose(same[1], nominal[1])


def test_merge_reasons_spans_and_counters(spark):
    tracks = spark.createDataFrame([(i, i % 2 == 0, None, "determined", 10.0, 8.0, 11.0, i == 7, i != 9) for i in range(10)], "key long, auto_crosses boolean, auto_time double, status string, keyframe double, first_t double, last_t double, disputed boolean, has_action boolean")
    reviews = spark.createDataFrame([(0, True, True, 0.5, False), (1, True, True, 3.0, False), (2, True, True, None, True), (3, True, True, None, False), (4, True, None, None, False), (5, True, False, None, False), (6, False, None, None, False), (42, True, True, 1.0, False)], "key long, answered boolean, crosses boolean, seconds double, before boolean")
    merged = verdicts.merge(tracks.where("has_action"), reviews)
    got = {r["key"]: (r["status"], r["crosses"], r["crossing_time"], r["reason"], r["outside_span"]) for r in merged.collect()}
    assert got == {
        0: ("determined", True, 10.5, None, False),
        1: ("determined", True, 13.0, None, True),
        2: ("undetermined", True, None, "crossing_started_before_observation", False),
        3: ("undetermined", True, None, "human_gave_no_crossing_time", False),
        4: ("undetermined", None, None, "human_uncertain", False),
        5: ("determined", False, None, None, False),
        6: ("determined", True, None, None, False),
        7: ("determined", False, None, None, False),
        8: ("determined", True, None, None, False),
    }
    assert verdicts.counters(merged, tracks).first().asDict() == {
        "human_verified": 6, "human_uncertain": 1, "human_cross": 4, "flipped_no_to_cross": 2, "cross_without_anchorable_t_c": 2, "human_no_cross": 1,
        "flipped_cross_to_no": 0, "pv_disputed_unreviewed": 1, "geometry_kept": 3, "written": 9, "outside_span": 1, "no_action_record": 1,
    }
    assert [r["key"] for r in verdicts.unmatched(reviews, tracks).collect()] == [42]
    late = reviews.where(verdicts.needs_time(F.col("crosses"), F.col("seconds"), F.col("before"))).select("key").collect()
    assert [r["key"] for r in late] == [3]


def test_chains_take_each_follower_once(spark):
    edges = [(0, 1, 3, 0.5, 0.2, 1.0, 2.0), (0, 2, 3, 0.4, 0.1, 1.5, 2.0), (0, 2, 4, 0.4, 0.3, 1.5, 2.1), (0, 3, 5, 0.4, 0.3, 3.0, 3.5)]
    rows = spark.createDataFrame(edges, "seq long, track long, follower long, gap double, residual double, ends double, starts double")
    got = {}
    for r in stitching.chains(rows).orderBy("chain", "place").collect():
        got.setdefault(r["chain"], []).append(r["track"])
    assert got == {1: [1, 3, 5], 2: [2, 4]}


def test_frame_merge(spark):
    rows = [(1, 0, False, 50, 0, 1), (1, 0, True, 3, 1, 2), (1, 1, True, 3, 0, 3), (1, 1, True, 9, 1, 4), (1, 2, True, 5, 0, 5), (1, 2, True, 5, 1, 6)]
    got = stitching.merge_frames(spark.createDataFrame(rows, "track long, t_us long, observed boolean, points int, rank long, frame long"))
    assert sorted(r["frame"] for r in got.collect()) == [2, 4, 5]


def test_resolve(spark):
    """Every combination of a member's and the primary's tier, with the primary there or cut."""
    tracks = [("g1", True), ("s1", False), ("s2", False), ("s3", False), ("g2", True), ("g3", True), ("s4", False), ("s5", False), ("g5", True), ("u", None), ("x", False)]
    groups = [(1, "g1", True, True), (1, "s1", False, True), (2, "s2", True, False), (2, "s3", False, False), (2, "u", False, False), (3, "g2", True, True), (3, "g3", False, True), (4, "gone silver", True, False), (4, "s4", False, False), (5, "gone gold", True, True), (5, "s5", False, True), (5, "g5", False, True)]
    got = stitching.resolve(spark.createDataFrame(tracks, "key string, gold boolean"), spark.createDataFrame(groups, "chain long, key string, primary boolean, primary_gold boolean"))
    fates = {k: ("keep", None) for k, _ in tracks} | {"s1": ("drop", None), "s3": ("fold", "s2"), "s5": ("drop", None)}
    assert {r["key"]: (r["fate"], r["into"]) for r in got.collect()} == fates


def test_proposals_and_fold(spark):
    """Three silver fragments in a row, the middle one is seen most; a gold track takes over another; one stands alone."""
    rows = [(0, tr, 10 * tr + i, t, t * 1_000_000, True, 20, float(t) + x, 0.0, anchor) for tr, times, x, anchor in ((1, (0, 1, 2), 0, False), (2, (3, 4, 5, 6), 0, False), (3, (7, 8), 0, False), (4, (0, 1), 500, False), (5, (2, 3), 500, True), (6, (0, 1), 900, False)) for i, t in enumerate(times)]
    rows += [(0, 3, 99, 6, 6_000_000, False, -1, 6.0, 0.0, False), (0, 5, 98, 4, 4_000_000, True, -1, 504.0, 0.0, True)]
    frames = spark.createDataFrame([(a, b, c, float(d), *e) for a, b, c, d, *e in rows], "seq long, track long, frame long, t double, t_us long, observed boolean, points int, x double, y double, anchor boolean")
    ends = stitching.track_ends(frames)
    groups = stitching.proposals(stitching.continuation_edges(ends), ends)
    got = {r["chain"]: r for r in groups.collect()}
    assert {c: (r["primary_id"], r["primary_gold"], r["member_ids"], r["fragment_ids"]) for c, r in got.items()} == {1: (2, False, [1, 2, 3], [1, 3]), 4: (5, True, [4, 5], [4])}
    assert [tuple(x) for x in got[1]["links"]] == [(1, 2, 1.0, 0.0, 2.0), (2, 3, 1.0, 0.0, 2.0)]
    members = stitching.members_of(groups)
    tracks = ends.select(F.col("track").alias("key"), "gold")
    resolved = stitching.resolve(tracks, members)
    folded = stitching.fold(frames, resolved, members)
    out = {}
    for r in folded.collect():
        out.setdefault(r["track"], []).append((r["t"], r["came_from"], r["observed"]))
    assert {k: len(v) for k, v in out.items()} == {2: 9, 5: 3, 6: 2} and (6.0, 2, True) in out[2] and (6.0, 3, False) not in out[2]
    stats = {r["track"]: r for r in stitching.fold_stats(folded, resolved, members).collect()}
    assert stats[2]["stitched_from"] == [1, 3] and stats[2]["n_observed"] == 9 and stats[5]["stitched_from"] is None
    alone = stitching.fold(frames, stitching.resolve(tracks, members.where("false")), members.where("false"))
    assert alone.count() == frames.count()


def test_long_chains_are_walked(spark):
    links = spark.range(70).selectExpr("0L as seq", "id as track", "id + 1 as follower").where("track <> 40")
    got = {r["track"]: (r["chain"], r["place"]) for r in stitching.walk(links).collect()}
    assert got == {i: (0, i) if i <= 40 else (41, i - 41) for i in range(71)}


def test_answers_and_offsets(spark):
    said = spark.createDataFrame([(" Yes ",), ("hard to tell",), ("",), (None,), ("no",)], "s string").select(verdicts.answer(F.col("s")).alias("a")).collect()
    assert [(r["a"]["answered"], r["a"]["crosses"]) for r in said] == [(True, True), (True, None), (False, None), (False, None), (True, False)]
    with pytest.raises(Exception, match="unknown answer"):
        spark.createDataFrame([("yep",)], "s string").select(verdicts.answer(F.col("s"))).collect()
    moments = spark.createDataFrame([("+4.5",), ("-0.5",), ("pre_obs",), ("",), ("soon",)], "s string").select(verdicts.offset(F.col("s")).alias("o")).collect()
    assert [(r["o"]["seconds"], r["o"]["before"]) for r in moments] == [(4.5, False), (-0.5, False), (None, True), (None, False), (None, False)]


def test_verdict_merge(spark):
    tracks = spark.createDataFrame([(i, True, 1.0, "determined", 10.0) for i in range(6)], "key long, auto_crosses boolean, auto_time double, status string, keyframe double")
    reviews = [(0, True, False, None, False), (1, True, True, 3.5, False), (2, True, True, None, True), (3, True, True, None, False), (4, True, None, None, False)]
    rows = spark.createDataFrame(reviews, "key long, answered boolean, crosses boolean, seconds double, before boolean")
    got = {r["key"]: (r["status"], r["crosses"], r["crossing_time"]) for r in verdicts.merge(tracks, rows).collect()}
    assert got == {
        0: ("determined", False, None),
        1: ("determined", True, 13.5),
        2: ("undetermined", True, None),  # the crossing is known, its time is not
        3: ("undetermined", True, None),
        4: ("undetermined", None, None),
        5: ("determined", True, 1.0),
    }
    one = rows.where("key < 2")
    assert verdicts.union_batches(one, rows.where("key >= 2")).count() == 5
    with pytest.raises(ValueError):
        verdicts.union_batches(one, rows)


def test_auc_and_ap(spark):
    scored = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    row = scoring.ranking_metrics(scored).first()
    assert (row["roc_auc"], row["average_precision"]) == pytest.approx((0.75, 5 / 6))
    assert scoring.ranking_metrics(scored.where("label = 1")).count() == 0


def test_box_features(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    rows = spark.createDataFrame([([(0.0, 0.0, 2.0, 2.0), None, (2.0, 0.0, 4.0, 2.0)],)], f"b array<{box}>")
    assert rows.select(scoring.box_features(F.col("b"), 3, 10.0, 10.0)).first()[0] is None
    got = rows.select(scoring.box_features(F.col("b"), 2, 10.0, 10.0)).first()[0]
    assert got[0] == pytest.approx([0.1, 0.1, 0.2, 0.2, 0, 0, 0, 0]) and got[1][4:] == pytest.approx([0.2, 0, 0, 0])


def test_split_deal():
    masses = pd.DataFrame({"seq": range(60), "n_samples": [i % 7 for i in range(60)], "n_tte": [i % 4 for i in range(60)]})
    for seed in range(3):
        dealt = splits.deal(masses, seed)
        assert sorted(dealt["seq"]) == list(range(60)) and set(dealt["split"]) <= set(stats.SPLITS)
        assert splits.deal(masses, seed).equals(dealt)
    with pytest.raises(ValueError):
        splits.deal(masses, 0, {"a": 0.5, "b": 0.2, "c": 0.2})
    with pytest.raises(ValueError):
        splits.deal(masses, 0, {"a": 0.5, "b": 0.5})
    lone = pd.DataFrame({"seq": [1], "n_samples": [0], "n_tte": [0]})
    assert len(splits.deal(lone, 0)) == 1


def test_exact_balance_scores_zero(spark):
    masses = spark.createDataFrame([(1, 70, 7), (2, 10, 1), (3, 20, 2)], "seq long, n_samples long, n_tte long")
    where = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test")], "seq long, split string")
    assert stats.balance(masses, where).first()[0] == pytest.approx(0, abs=1e-12)


def test_unknown_sequence_is_an_error(spark):
    index = spark.createDataFrame([(1, "x"), (2, "x")], "seq long, split string")
    known = spark.createDataFrame([(1, "train")], "seq long, split string")
    with pytest.raises(Exception, match="no split for sequence 2"):
        stats.stamp(index, known).collect()
    for bad in (dict(tier="bronze"), dict(crossing=True, horizon=3.0)):
        with pytest.raises(ValueError):
            stats.select(index, **bad)


def test_verify(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("new", "3")], "path string, sha256 string")
    assert {r["path"]: r["problem"] for r in integrity.verify(a, b).collect()} == {"y": "CHANGED", "z": "MISSING", "new": "UNLISTED"}
    assert integrity.verify(a, a).count() == 0
