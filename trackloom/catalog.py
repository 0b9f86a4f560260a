"""All registered queries of the track engine, with their SQL oracles.

The library's operators run on the driver's tables through `plans.adapters`; every parameter that does
not suit these tables (window lengths, thresholds) is passed here, and the defaults stay.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import geometry as G
from .operators import guarded, integrity, lifting, quality, scoring, spatial, splits, stats, stitching, temporal, tracking, verdicts, windows
from .plans.adapters import FRAMES_SQL, POINTS_SQL, SAMPLES_SQL, frames, points, samples, table
from .session import written
from .streaming import online

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# ---- track quality ------------------------------------------------------------------------------

LIMITS = quality.Thresholds(coverage=0.6, duration=25.0, points=45, confidence=0.3, speed=15_000.0, fast=60_000.0)

STEP_SQL = "sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2))"
METRICS_SQL = f"""{FRAMES_SQL},
steps AS (SELECT track, t - lag(t) OVER w AS dt, {STEP_SQL} AS dx FROM frames WINDOW w AS (PARTITION BY track ORDER BY t, frame)),
fast AS (SELECT track, max(dx / dt) AS max_speed FROM steps WHERE dt > 0 GROUP BY track),
marked AS (SELECT track, t, observed, sum(observed::INT) OVER (PARTITION BY track ORDER BY t, frame) AS run, sum(observed::INT) OVER (PARTITION BY track) AS all_seen FROM frames),
runs AS (SELECT track, run::BIGINT AS run, count(*) AS n_frames, min(t) AS t_start, max(t) AS t_end, run > 0 AND run < any_value(all_seen) AS internal FROM marked WHERE NOT observed GROUP BY track, run),
coasts AS (SELECT track, max(n_frames) AS longest_coast, count(*) AS n_coasts FROM runs GROUP BY track),
base AS (SELECT seq, track, count(*) AS n_frames, count(*) FILTER (observed) AS n_observed, count(*) FILTER (observed AND points >= 0) AS n_measured,
    avg(observed::INT) AS observed_fraction, count(*) FILTER (observed AND points >= 0) / count(*) AS coverage, max(t) - min(t) AS duration,
    coalesce(CAST(trunc(median(points) FILTER (observed AND points >= 0)) AS INT), 0) AS median_points,
    coalesce(median(confidence) FILTER (observed), 0.0) AS median_confidence
  FROM frames GROUP BY seq, track),
metrics AS (SELECT base.*, coalesce(longest_coast, 0) AS longest_coast, coalesce(n_coasts, 0) AS n_coasts, coalesce(max_speed, 0.0) AS max_speed
  FROM base LEFT JOIN coasts USING (track) LEFT JOIN fast USING (track)),
flagged AS (SELECT *, list_filter([CASE WHEN n_measured = 0 THEN 'EMPTY' END,
    CASE WHEN n_measured > 0 AND round(coverage, 3) < {LIMITS.coverage} THEN 'LOW_COVERAGE' END, CASE WHEN round(duration, 2) < {LIMITS.duration} THEN 'SHORT' END,
    CASE WHEN median_points < {LIMITS.points} THEN 'SPARSE_LIFT' END, CASE WHEN round(median_confidence, 3) < {LIMITS.confidence} THEN 'LOW_CONF' END,
    CASE WHEN round(max_speed, 2) > {LIMITS.speed} THEN 'JITTER' END], lambda f: f IS NOT NULL) AS found FROM metrics),
tracks AS (SELECT * EXCLUDE (found), array_to_string(found, '|') AS flags, CAST(len(found) AS INT) AS n_flags,
    CASE WHEN list_has_any(found, ['EMPTY', 'JITTER']) THEN 'bad' WHEN list_has_any(found, ['LOW_COVERAGE', 'SPARSE_LIFT', 'LOW_CONF']) THEN 'marginal' ELSE 'good' END AS tier
  FROM flagged)"""


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.track_quality(frames(spark, sf_dir), LIMITS)


@query(f"""WITH {METRICS_SQL}
SELECT seq, track, n_frames, n_observed, n_measured, round(observed_fraction, 6) AS observed_fraction, round(coverage, 6) AS coverage, round(duration, 6) AS duration, median_points,
  round(median_confidence, 6) AS median_confidence, longest_coast, n_coasts, round(max_speed, 6) AS max_speed, flags, n_flags, tier FROM tracks""")
def track_quality(spark, sf_dir):
    return rounded(_quality(spark, sf_dir))


@query(f"""WITH {METRICS_SQL}
SELECT seq, count(*) AS n_tracks, count(*) FILTER (tier = 'good') AS good, count(*) FILTER (tier = 'marginal') AS marginal,
  count(*) FILTER (tier = 'bad') AS bad, count(*) FILTER (contains(flags, 'SHORT')) AS short, round(avg((tier = 'good')::INT), 6) AS good_fraction
FROM tracks GROUP BY seq""")
def quality_rollup(spark, sf_dir):
    return rounded(quality.rollup(_quality(spark, sf_dir)))


@query(f"""WITH {METRICS_SQL}
SELECT track, n_flags, round(coverage, 6) AS coverage, flags, tier FROM tracks ORDER BY n_flags DESC, tracks.coverage, track LIMIT 30""")
def review_queue_topk(spark, sf_dir):
    return rounded(quality.review_queue(_quality(spark, sf_dir)))


@query(f"""WITH {METRICS_SQL} SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, '|')) AS flag FROM tracks WHERE flags <> '') GROUP BY flag""")
def flag_counts(spark, sf_dir):
    return quality.flag_counts(_quality(spark, sf_dir))


@query(f"""WITH {METRICS_SQL},
cut AS (SELECT list_filter([CASE WHEN contains(flags, 'JITTER') THEN 'jitter' END, CASE WHEN tier = 'bad' THEN 'bad_tier' END,
  CASE WHEN round(max_speed, 2) > {LIMITS.fast} THEN 'fast' END], lambda r: r IS NOT NULL) AS reasons FROM tracks)
SELECT entry, count(*) AS n FROM (SELECT CASE WHEN len(reasons) > 0 THEN 'dropped' ELSE 'kept' END AS entry FROM cut
  UNION ALL SELECT 'reason:' || unnest(reasons) FROM cut) GROUP BY entry""")
def cut_manifest(spark, sf_dir):
    return quality.cut_manifest(_quality(spark, sf_dir), LIMITS)


@query(f"""WITH {METRICS_SQL},
long AS (SELECT unnest(['coverage', 'duration', 'max_speed']) AS metric, unnest([coverage, duration, max_speed]) AS value FROM tracks)
SELECT metric, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM long GROUP BY metric""")
def percentiles_corpus(spark, sf_dir):
    return rounded(quality.percentiles(_quality(spark, sf_dir), ["coverage", "duration", "max_speed"]))


# ---- frames in time -----------------------------------------------------------------------------


@query(f"WITH {METRICS_SQL} SELECT track, run, n_frames, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, internal FROM runs")
def coast_islands(spark, sf_dir):
    return rounded(temporal.coast_runs(frames(spark, sf_dir)))


@query(f"""WITH {METRICS_SQL}
SELECT track, n_frames AS gap_frames, round(t_end - t_start, 6) AS gap_seconds FROM runs WHERE internal
QUALIFY row_number() OVER (PARTITION BY track ORDER BY n_frames DESC, t_start) = 1""")
def bridged_gap(spark, sf_dir):
    return rounded(temporal.longest_bridged(frames(spark, sf_dir)))


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT track, frame, t - lag(t) OVER w AS dt, {STEP_SQL} AS dx FROM frames WINDOW w AS (PARTITION BY track ORDER BY t, frame))
SELECT track, frame, round(dt, 6) AS dt, round(dx / dt, 4) AS speed FROM s WHERE dt > 0""")
def interframe_speed(spark, sf_dir):
    return temporal.speeds(frames(spark, sf_dir)).select("track", "frame", F.round("dt", 6).alias("dt"), F.round("speed", 4).alias("speed"))


@query(f"""WITH {FRAMES_SQL},
n AS (SELECT track, frame, x, t - lag(t) OVER w AS hs, lead(t) OVER w - t AS hd, lag(x) OVER w AS b, lead(x) OVER w AS a FROM frames WINDOW w AS (PARTITION BY track ORDER BY t, frame))
SELECT track, frame, round(coalesce((hs * hs * a + (hd * hd - hs * hs) * x - hd * hd * b) / (hs * hd * (hs + hd)), (a - x) / hd, (x - b) / hs), 4) AS velocity FROM n""")
def velocity_gradient(spark, sf_dir):
    return rounded(temporal.gradient(frames(spark, sf_dir)), 4)


@query(f"""WITH {FRAMES_SQL},
p AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, frame) AS place FROM frames),
k AS (SELECT *, CASE WHEN kind = 'purchase' THEN place END AS own_place, CASE WHEN kind = 'purchase' THEN x END AS own FROM p),
f AS (SELECT *, last_value(own_place IGNORE NULLS) OVER b AS bp, last_value(own IGNORE NULLS) OVER b AS bv, first_value(own_place IGNORE NULLS) OVER a AS ap, first_value(own IGNORE NULLS) OVER a AS av
  FROM k WINDOW b AS (PARTITION BY track ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track ORDER BY t, frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track, frame, coalesce(CASE WHEN ap IS NULL OR place - bp <= ap - place THEN bv ELSE av END, 0.0) AS value,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN bp IS NULL AND ap IS NULL THEN 'undefined' ELSE 'filled' END AS origin FROM f""")
def nearest_fill(spark, sf_dir):
    return temporal.nearest_fill(frames(spark, sf_dir), F.col("x"), F.col("kind") == "purchase")


ONSET = 150.0
ONSET_SQL = f"""onsets AS (SELECT track, arg_min(frame, t) FILTER (x > {ONSET}) AS onset_frame, min(t) FILTER (x > {ONSET}) AS onset_t, arg_min(observed, t) FILTER (x > {ONSET}) AS onset_observed FROM frames GROUP BY track)"""


@query(f"WITH {FRAMES_SQL}, {ONSET_SQL} SELECT track, onset_frame, round(onset_t, 6) AS onset_t, onset_observed FROM onsets")
def first_true_onset(spark, sf_dir):
    return rounded(temporal.first_true(frames(spark, sf_dir), F.col("x") > ONSET))


@query(f"""WITH {FRAMES_SQL}
SELECT l.track, l.frame, round(r.t, 6) AS match_t, r.x AS match_value FROM (SELECT * FROM frames WHERE kind = 'purchase') l
ASOF LEFT JOIN (SELECT * FROM frames WHERE kind = 'click') r ON l.track = r.track AND l.t >= r.t""")
def asof_backward(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rounded(temporal.asof_backward(rows.where("kind = 'purchase'"), rows.where("kind = 'click'"), F.col("x")))


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT * FROM frames WHERE kind = 'purchase'), r AS (SELECT * FROM frames WHERE kind = 'click'),
b AS (SELECT l.track, l.frame, l.t, r.t AS bt, r.x AS bv FROM l ASOF LEFT JOIN r ON l.track = r.track AND l.t >= r.t),
a AS (SELECT b.*, r.t AS nt, r.x AS av FROM b ASOF LEFT JOIN r ON b.track = r.track AND b.t < r.t),
m AS (SELECT track, frame, t, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bt ELSE nt END AS mt, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bv ELSE av END AS mv FROM a)
SELECT track, frame, round(mt, 6) AS match_t, mv AS match_value, round(abs(t - mt), 6) AS gap FROM m WHERE abs(t - mt) <= 0.25""")
def asof_nearest_tol(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rounded(temporal.asof_nearest(rows.where("kind = 'purchase'"), rows.where("kind = 'click'"), F.col("x"), 0.25))


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT * FROM frames WHERE NOT observed), r AS (SELECT * FROM frames WHERE observed),
b AS (SELECT l.track, l.frame, l.t, r.t AS bt, r.x AS bv FROM l ASOF LEFT JOIN r ON l.track = r.track AND l.t >= r.t),
a AS (SELECT b.*, r.t AS nt, r.x AS av FROM b ASOF LEFT JOIN r ON b.track = r.track AND b.t < r.t)
SELECT track, frame, round(CASE WHEN bt IS NULL THEN av WHEN nt IS NULL OR bt = t THEN bv ELSE bv + (t - bt) / (nt - bt) * (av - bv) END, 6) AS value FROM a""")
def lerp_at_times(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rounded(temporal.interpolate(rows.where("not observed"), rows.where("observed"), F.col("x")))


SIGNUPS_SQL = "signups AS (SELECT track, frame AS \"window\", t AS start, t + 2.0 AS \"end\" FROM frames WHERE kind = 'signup')"
HITS_SQL = 'FROM signups w JOIN frames f ON f.track = w.track AND f.t >= w.start - 0.0001 AND f.t <= w."end" + 0.0001'


def _signups(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'signup'").select("track", F.col("frame").alias("window"), F.col("t").alias("start"), (F.col("t") + 2.0).alias("end"))


@query(f"""WITH {FRAMES_SQL}, {SIGNUPS_SQL} SELECT w.track, w."window", count(*) AS n_frames, CAST(sum(f.points) AS BIGINT) AS points {HITS_SQL} GROUP BY w.track, w."window" """)
def range_join_window(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return temporal.in_windows(_signups(rows), rows).groupBy("track", "window").agg(F.count("*").alias("n_frames"), F.sum("points").alias("points"))


@query(f"""WITH {FRAMES_SQL}, {SIGNUPS_SQL} SELECT w.track, w."window", count(f.frame) AS n_frames, round(avg(f.observed::INT), 6) AS fraction
{HITS_SQL.replace(' JOIN', ' LEFT JOIN')} GROUP BY w.track, w."window" """)
def observed_fraction(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return rounded(temporal.observed_fraction(_signups(rows), rows).drop("start", "end"))


# ---- windows before events ----------------------------------------------------------------------

LENGTH = 3.0
WINDOWS_SQL = f"""{FRAMES_SQL}, {ONSET_SQL},
spans AS (SELECT track, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY track),
each AS (SELECT track, unnest([0, 1, 2]) AS place, unnest([1.0::DOUBLE, 1.5, 2.0]) AS horizon, onset_t, onset_observed, t0, t1 FROM onsets JOIN spans USING (track) WHERE onset_t IS NOT NULL),
cuts AS (SELECT *, onset_t - horizon AS "end", (onset_t - horizon) - {LENGTH}::DOUBLE AS start FROM each),
proposals AS (SELECT track, place AS "window", horizon, start, "end", onset_t, onset_observed,
    CASE WHEN NOT (start >= t0 - 0.0001 AND "end" <= t1 + 0.0001) THEN 'window_outside_track' END AS skip_reason
  FROM cuts QUALIFY row_number() OVER (PARTITION BY track, floor(start * 1000 + 0.5) ORDER BY place DESC) = 1),
shares AS (SELECT w.track, w."window", count(f.frame) AS n_frames, avg(f.observed::INT) AS fraction
  FROM proposals w LEFT JOIN frames f ON f.track = w.track AND f.t >= w.start - 0.0001 AND f.t <= w."end" + 0.0001 GROUP BY w.track, w."window")"""


def _proposals(rows: DataFrame) -> DataFrame:
    return windows.event_windows(rows, F.col("x") > ONSET, length=LENGTH)


@query(f"""WITH {WINDOWS_SQL} SELECT track, "window", horizon, round(start, 6) AS start, round("end", 6) AS "end", round(onset_t, 6) AS onset_t, onset_observed, skip_reason FROM proposals""")
def tte_windows(spark, sf_dir):
    return rounded(_proposals(frames(spark, sf_dir)))


CLOSEST_SQL = f"""ends AS (SELECT track, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY track),
p AS (SELECT f.track, f.frame AS "window", abs(f.x - 50) AS distance, f.t AS moment, least(greatest(f.t, t0 + {LENGTH}), t1) AS "end"
  FROM frames f JOIN ends USING (track) WHERE observed AND t1 - t0 >= {LENGTH} - 0.0001),
w AS (SELECT *, "end" - {LENGTH}::DOUBLE AS start FROM p),
s AS (SELECT w.track, w."window", any_value(distance) AS distance, any_value(moment) AS moment, any_value(start) AS start, any_value("end") AS "end", avg(f.observed::INT) AS fraction
  FROM w JOIN frames f ON f.track = w.track AND f.t >= w.start - 0.0001 AND f.t <= w."end" + 0.0001 GROUP BY w.track, w."window"),
best AS (SELECT * FROM s WHERE fraction >= 0.7 QUALIFY row_number() OVER (PARTITION BY track ORDER BY s.distance, moment, "window") = 1),
closest AS (SELECT e.track, "window", distance, start, "end", fraction,
  CASE WHEN t1 - t0 < {LENGTH} - 0.0001 THEN 'window_outside_track' WHEN b.track IS NULL THEN 'comparison_window_unobserved' END AS skip_reason FROM ends e LEFT JOIN best b ON b.track = e.track)"""


@query(f"""WITH {FRAMES_SQL}, {CLOSEST_SQL}
SELECT track, "window", round(distance, 6) AS distance, round(start, 6) AS start, round("end", 6) AS "end", round(fraction, 6) AS fraction, skip_reason FROM closest""")
def closest_observed_window(spark, sf_dir):
    return rounded(windows.best_observed_window(frames(spark, sf_dir), F.abs(F.col("x") - 50), length=LENGTH))


def _measured(rows: DataFrame) -> DataFrame:
    return temporal.observed_fraction(_proposals(rows), rows)


@query(f"""WITH {WINDOWS_SQL},
l AS (SELECT p.*, s.fraction, s.n_frames / 8.0::DOUBLE AS road_distance,
    {", ".join(f'''CASE WHEN onset_t >= "end" - 0.0001 AND onset_t <= "end" + {h}::DOUBLE + 0.0001 THEN 'crossing' ELSE 'not_crossing' END AS intent_{n}''' for h, n in (('1.0', 'h1_0'), ('1.5', 'h1_5'), ('2.0', 'h2_0'), ('horizon', 'own')))}
  FROM proposals p JOIN shares s USING (track, "window"))
SELECT track, "window", intent_h1_0, intent_h1_5, intent_h2_0, intent_own AS intent,
  round(fraction * CASE WHEN intent_own = 'crossing' AND NOT onset_observed THEN 0.6 WHEN intent_own <> 'crossing' AND road_distance < 1.0 THEN 0.7 ELSE 1.0 END, 6) AS confidence FROM l""")
def intent_by_horizon(spark, sf_dir):
    rows = _measured(frames(spark, sf_dir)).withColumn("road_distance", F.col("n_frames") / 8.0)
    at = F.col("labels_by_horizon")
    return windows.intents(rows).select("track", "window", *[F.element_at(at, str(h)).alias(f"intent_{stats.horizon_column(h)}") for h in windows.HORIZONS], "intent", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {WINDOWS_SQL}
SELECT coalesce(skip_reason, CASE WHEN n_frames = 0 THEN 'no_track_frames' WHEN n_frames < 5 THEN 'few_frames' WHEN fraction < 0.7 THEN 'low_observed' END, 'accepted') AS reason, count(*) AS n
FROM proposals JOIN shares USING (track, "window") GROUP BY 1""")
def skip_histogram(spark, sf_dir):
    gates = windows.gate([("no_track_frames", F.col("n_frames") == 0), ("few_frames", F.col("n_frames") < 5), ("low_observed", F.col("fraction") < 0.7)])
    return windows.skip_histogram(_measured(frames(spark, sf_dir)).withColumn("skip_reason", F.coalesce("skip_reason", gates)))


@query(f"""WITH {WINDOWS_SQL} SELECT p.track, p."window", count(*) FILTER (f.t <= p."end") AS n_observed, count(*) FILTER (f.t > p."end") AS n_future, count(*) AS n_all
FROM proposals p JOIN frames f ON f.track = p.track GROUP BY p.track, p."window" """)
def leak_guard_split(spark, sf_dir):
    rows = frames(spark, sf_dir)
    return windows.parts(_proposals(rows), rows)


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT seq, track, min(abs(x - 50)) AS closest FROM frames GROUP BY seq, track)
SELECT seq, track, round(closest, 6) AS closest FROM c QUALIFY row_number() OVER (PARTITION BY seq ORDER BY c.closest, track) = 1""")
def key_member(spark, sf_dir):
    return rounded(spatial.key_member(frames(spark, sf_dir), F.abs(F.col("x") - 50)))


# ---- the sample index ---------------------------------------------------------------------------

COUNTS_SQL = "count(*) AS n_rows, count(DISTINCT (seq, pedestrian)) AS n_pedestrians, count(*) FILTER (h2_0) AS n_crossing, round(avg(h2_0::INT), 6) AS ratio"


@query(f"WITH {SAMPLES_SQL} SELECT tier, split, {COUNTS_SQL} FROM samples WHERE split IS NOT NULL GROUP BY tier, split")
def composition(spark, sf_dir):
    return rounded(stats.composition(samples(spark, sf_dir)))


@query(f"""WITH {SAMPLES_SQL}, g AS (SELECT tier, split, CAST(GROUPING(tier, split) AS INT) AS level, {COUNTS_SQL} FROM samples GROUP BY GROUPING SETS ((tier, split), (tier), ()))
SELECT * FROM g WHERE level > 0 OR split IS NOT NULL""")
def composition_grouping_sets(spark, sf_dir):
    return rounded(stats.composition_sets(samples(spark, sf_dir)))


@query(f"""WITH {SAMPLES_SQL} SELECT seq, pedestrian, "window" FROM samples WHERE split = 'train' AND tier = 'gold' AND h1_5""")
def select_population(spark, sf_dir):
    return stats.select(samples(spark, sf_dir), "train", "gold", True, 1.5).select("seq", "pedestrian", "window")


@query("""SELECT 'customers' AS stage, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'samples', count(*) FROM lineitem
UNION ALL SELECT 'with_orders', count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'""")
def funnel(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return stats.funnel(
        {
            "customers": table(spark, sf_dir, "customer"),
            "orders": orders,
            "samples": table(spark, sf_dir, "lineitem"),
            "with_orders": orders.select("o_custkey").distinct(),
            "finished": orders.where("o_orderstatus = 'F'"),
        }
    )


#: Suppliers, and numbers that no supplier has: sequences without samples.
SEQUENCES_SQL = "(SELECT s_suppkey AS seq FROM supplier UNION ALL SELECT -s_suppkey FROM supplier)"
MASSES_SQL = f"""{SAMPLES_SQL},
masses AS (SELECT w.seq, coalesce(n_samples, 0) AS n_samples, coalesce(n_tte, 0) AS n_tte FROM {SEQUENCES_SQL} w
  LEFT JOIN (SELECT seq, count(*) AS n_samples, count(*) FILTER (tte) AS n_tte FROM samples GROUP BY seq) s ON s.seq = w.seq)"""


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("s_suppkey")
    sequences = table(spark, sf_dir, "supplier").select(F.explode(F.array(own, -own)).alias("seq"))
    return stats.masses(sequences, samples(spark, sf_dir))


def _split_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(seq.alias("seq"), F.when(seq % 10 < 7, "train").when(seq % 10 == 7, "val").otherwise("test").alias("split"))


SPLIT_MAP_SQL = "split_map AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM supplier)"


@query(f"WITH {MASSES_SQL} SELECT * FROM masses")
def split_masses_zero_filled(spark, sf_dir):
    return _masses(spark, sf_dir)


@query(f"""WITH {SAMPLES_SQL}, {SPLIT_MAP_SQL} SELECT s.tier, m.split, count(*) AS n FROM samples s JOIN split_map m USING (seq) GROUP BY s.tier, m.split""")
def split_stamp_checked(spark, sf_dir):
    return stats.stamp(samples(spark, sf_dir), _split_map(spark, sf_dir)).groupBy("tier", "split").agg(F.count("*").alias("n"))


@query(f"""WITH {SAMPLES_SQL}, s AS (SELECT split, count(DISTINCT seq) AS n_sequences, count(*) AS n_rows, count(*) FILTER (tte) AS n_tte,
  count(*) FILTER (h1_0) AS n_h1_0, count(*) FILTER (h1_5) AS n_h1_5, count(*) FILTER (h2_0) AS n_h2_0 FROM samples WHERE split IS NOT NULL GROUP BY split)
SELECT split, coalesce(n_sequences, 0) AS n_sequences, coalesce(n_rows, 0) AS n_rows, coalesce(n_tte, 0) AS n_tte, coalesce(n_h1_0, 0) AS n_h1_0,
  coalesce(n_h1_5, 0) AS n_h1_5, coalesce(n_h2_0, 0) AS n_h2_0, round(coalesce(n_rows, 0) / sum(n_rows) OVER (), 6) AS share
FROM (VALUES ('train'), ('val'), ('test')) v(split) LEFT JOIN s USING (split)""")
def split_summary(spark, sf_dir):
    return rounded(stats.split_summary(samples(spark, sf_dir)))


@query(f"""WITH {MASSES_SQL}, {SPLIT_MAP_SQL},
own AS (SELECT split, sum(n_samples) AS s, sum(n_tte) AS t FROM masses JOIN split_map USING (seq) GROUP BY split),
shares AS (SELECT target, coalesce(s, 0) / sum(s) OVER () AS a, coalesce(t, 0) / sum(t) OVER () AS b FROM (VALUES ('train', 0.7::DOUBLE), ('val', 0.1), ('test', 0.2)) v(split, target) LEFT JOIN own USING (split))
SELECT round(sum(abs(a - target) + abs(b - target)), 6) AS score FROM shares""")
def balance_score(spark, sf_dir):
    return rounded(stats.balance(_masses(spark, sf_dir), _split_map(spark, sf_dir)))


@query()
def split_deal(spark, sf_dir):
    return splits.best_deal(_masses(spark, sf_dir))


# ---- reviewers' verdicts ------------------------------------------------------------------------

REVIEW_SQL = """tracks AS (SELECT doc_id AS key, n_chars % 3 = 0 AS auto_crosses, CASE WHEN n_chars % 3 = 0 THEN n_chars / 10.0::DOUBLE END AS auto_time,
    CASE WHEN n_chars % 11 = 0 THEN 'undetermined' ELSE 'determined' END AS status, CAST(n_chars AS DOUBLE) AS keyframe, n_chars - 5.0::DOUBLE AS first_t, n_chars + 1.0::DOUBLE AS last_t,
    n_chars % 7 = 0 AS disputed, n_chars % 13 <> 0 AS has_action FROM documents),
reviews AS (SELECT doc_id AS key, quality = 1 AS yes, max(toxic) = 1 AS unsure, doc_id % 4 AS how FROM labels GROUP BY doc_id, quality),
said AS (SELECT key, true AS reviewed, CASE WHEN unsure THEN NULL ELSE yes END AS said, CASE how WHEN 1 THEN 1.5 WHEN 3 THEN -0.5 END::DOUBLE AS seconds, how = 0 AS "before" FROM reviews),
j AS (SELECT t.*, coalesce(s.reviewed, false) AS reviewed, s.said, s.seconds, s."before" FROM (SELECT * FROM tracks WHERE has_action) t LEFT JOIN said s USING (key)),
merged AS (SELECT key, reviewed, first_t, last_t, auto_crosses, disputed AND NOT reviewed AS disputed,
    CASE WHEN NOT reviewed THEN status WHEN said IS NULL OR (said AND seconds IS NULL) THEN 'undetermined' ELSE 'determined' END AS status,
    CASE WHEN NOT reviewed THEN auto_crosses ELSE said END AS crosses,
    CASE WHEN NOT reviewed THEN auto_time WHEN said AND seconds IS NOT NULL THEN keyframe + seconds END AS crossing_time,
    CASE WHEN NOT reviewed THEN NULL WHEN said IS NULL THEN 'human_uncertain' WHEN said AND seconds IS NULL AND "before" THEN 'crossing_started_before_observation'
      WHEN said AND seconds IS NULL THEN 'human_gave_no_crossing_time' END AS reason FROM j),
marked AS (SELECT *, coalesce(reviewed AND crossing_time IS NOT NULL AND NOT crossing_time BETWEEN first_t AND last_t, false) AS outside_span FROM merged)"""


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"),
        (n % 3 == 0).alias("auto_crosses"),
        F.when(n % 3 == 0, n / 10.0).alias("auto_time"),
        F.when(n % 11 == 0, "undetermined").otherwise("determined").alias("status"),
        n.cast("double").alias("keyframe"),
        (n - 5.0).alias("first_t"),
        (n + 1.0).alias("last_t"),
        (n % 7 == 0).alias("disputed"),
        (n % 13 != 0).alias("has_action"),
    )


def _worksheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and offsets as reviewers write them."""
    how = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "labels").groupBy("doc_id", "quality").agg(F.max("toxic").alias("toxic"))
    said = F.when(F.col("toxic") == 1, " Hard to tell ").when(F.col("quality") == 1, "Yes").otherwise("no ")
    moment = F.when(how == 0, "pre_obs").when(how == 1, "+1.5").when(how == 2, "soon").otherwise("-0.5")
    return rows.select(F.col("doc_id").alias("key"), said.alias("said"), moment.alias("offset"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worksheet(spark, sf_dir).select("key", verdicts.answer(F.col("said")).alias("a"), verdicts.offset(F.col("offset")).alias("o")).select("key", "a.*", "o.*")


@query(f"WITH {REVIEW_SQL} SELECT key, status, crosses, round(crossing_time, 6) AS crossing_time, reviewed, reason, outside_span, disputed, auto_crosses FROM marked")
def verdict_merge(spark, sf_dir):
    return rounded(verdicts.merge(_tracks(spark, sf_dir).where("has_action"), _reviews(spark, sf_dir)).drop("overrode"))


@query(f"""WITH {REVIEW_SQL} SELECT count(*) FILTER (reviewed) AS human_verified, count(*) FILTER (reason = 'human_uncertain') AS human_uncertain, count(*) FILTER (reviewed AND crosses) AS human_cross,
  count(*) FILTER (reviewed AND crosses AND NOT auto_crosses) AS flipped_no_to_cross, count(*) FILTER (reason IN ('crossing_started_before_observation', 'human_gave_no_crossing_time')) AS cross_without_anchorable_t_c,
  count(*) FILTER (reviewed AND NOT crosses) AS human_no_cross, count(*) FILTER (reviewed AND NOT crosses AND auto_crosses) AS flipped_cross_to_no, count(*) FILTER (disputed) AS pv_disputed_unreviewed,
  count(*) FILTER (NOT reviewed) AS geometry_kept, count(*) AS written, count(*) FILTER (outside_span) AS outside_span, (SELECT count(*) FROM tracks WHERE NOT has_action) AS no_action_record FROM marked""")
def merge_counters(spark, sf_dir):
    tracks = _tracks(spark, sf_dir)
    return verdicts.counters(verdicts.merge(tracks.where("has_action"), _reviews(spark, sf_dir)), tracks)


@query(f"WITH {REVIEW_SQL} SELECT key, status, crosses AS now_crosses, auto_crosses AS was_crosses FROM marked WHERE reviewed AND auto_crosses IS DISTINCT FROM crosses")
def overridden_verdicts(spark, sf_dir):
    merged = verdicts.merge(_tracks(spark, sf_dir).where("has_action"), _reviews(spark, sf_dir))
    return merged.where("overrode is not null and not (overrode.crosses <=> crosses)").select("key", "status", F.col("crosses").alias("now_crosses"), F.col("overrode.crosses").alias("was_crosses"))


@query(f"WITH {REVIEW_SQL} SELECT key FROM said WHERE said AND seconds IS NULL AND NOT \"before\"")
def untimed_crossings(spark, sf_dir):
    return _reviews(spark, sf_dir).where(verdicts.needs_time(F.col("crosses"), F.col("seconds"), F.col("before"))).select("key")


@query("SELECT DISTINCT doc_id AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def unmatched_keys(spark, sf_dir):
    """Reviews of documents that are not among the tracks of the tier that is merged (here a language)."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("key"))
    return verdicts.unmatched(_reviews(spark, sf_dir), docs)


@query("SELECT doc_id AS key FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE n_chars > 2000")
def batch_overlap_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "key")
    return verdicts.overlap(docs.where("lang = 'en'"), docs.where("n_chars > 2000"))


# ---- stitching and tracking ---------------------------------------------------------------------

GATES = stitching.Gates(gap=2.0, overlap=0.3, residual=30.0, residual_per_second=20.0, height=20.0)
#: Tracks cut every five days, so that there is something to stitch; gold where a signup is among the frames, cut as junk where no frame has 60 points.
FRAGMENTS_SQL = f"""{FRAMES_SQL}, fragments AS (SELECT * REPLACE (track * 1000 + CAST(floor(t / 5) AS BIGINT) % 1000 AS track) FROM frames),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t DESC, frame DESC) AS latest FROM fragments WHERE observed AND points >= 0),
e AS (SELECT seq, track, count(*) AS n, min(t) AS first_t, arg_min(x, (t, frame)) AS first_x, arg_min("y", (t, frame)) AS first_y, max(t) AS last_t, arg_max(x, (t, frame)) AS last_x, arg_max("y", (t, frame)) AS last_y,
    min(t) FILTER (latest <= 5) AS tail_t, arg_min(x, (t, frame)) FILTER (latest <= 5) AS tail_x, arg_min("y", (t, frame)) FILTER (latest <= 5) AS tail_y, median(points) AS height FROM r GROUP BY seq, track),
tiers AS (SELECT track, bool_or(kind = 'signup') AS gold, coalesce(max(points), -1) < 60 AS junk FROM fragments GROUP BY track),
v AS (SELECT *, CASE WHEN last_t = tail_t THEN 0.0 ELSE (last_x - tail_x) / (last_t - tail_t) END AS vx, CASE WHEN last_t = tail_t THEN 0.0 ELSE (last_y - tail_y) / (last_t - tail_t) END AS vy FROM e JOIN tiers USING (track)),
p AS (SELECT a.seq, a.track, b.track AS follower, b.first_t - a.last_t AS gap, sqrt(power(a.last_x + a.vx * greatest(b.first_t - a.last_t, 0) - b.first_x, 2) + power(a.last_y + a.vy * greatest(b.first_t - a.last_t, 0) - b.first_y, 2)) AS residual,
    a.last_t AS ends, b.first_t AS starts FROM v a JOIN v b ON a.seq = b.seq AND a.track <> b.track AND b.first_t > a.first_t AND abs(a.height - b.height) <= {GATES.height}),
edges AS (SELECT *, {GATES.residual} + {GATES.residual_per_second} * greatest(gap, 0) AS allowed FROM p WHERE gap >= -{GATES.overlap} AND gap <= {GATES.gap} AND residual <= {GATES.residual} + {GATES.residual_per_second} * greatest(gap, 0))"""
#: Successors track by track with the list of those taken, then chains link by link.
CHAINS_SQL = f"""{FRAGMENTS_SQL},
wishes AS (SELECT seq, track, any_value(ends) AS ends, list(follower ORDER BY round(residual, 3), starts, follower) AS followers FROM edges GROUP BY seq, track),
turns AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY ends, track) AS turn FROM wishes),
greedy AS (SELECT DISTINCT seq, 0::BIGINT AS turn, []::BIGINT[] AS taken, NULL::BIGINT AS track, NULL::BIGINT AS follower FROM turns
  UNION ALL SELECT seq, turn, CASE WHEN f IS NULL THEN taken ELSE list_append(taken, f) END, track, f
  FROM (SELECT g.seq, g.taken, t.turn, t.track, list_filter(t.followers, lambda x: NOT list_contains(g.taken, x))[1] AS f FROM greedy g JOIN turns t ON t.seq = g.seq AND t.turn = g.turn + 1)),
links AS (SELECT g.seq, g.track, g.follower, edges.gap, edges.residual, edges.allowed FROM greedy g JOIN edges USING (track, follower) WHERE g.follower IS NOT NULL),
chains AS (SELECT seq, track AS chain, 0 AS place, track FROM links WHERE track NOT IN (SELECT follower FROM links)
  UNION ALL SELECT c.seq, c.chain, c.place + 1, l.follower FROM chains c JOIN links l ON l.track = c.track),
members AS (SELECT c.*, gold, n, max_by(c.track, (gold, n, -place)) OVER (PARTITION BY c.seq, chain) AS primary_id FROM chains c JOIN v ON v.track = c.track)"""
FOLD_SQL = f"""{CHAINS_SQL},
groups AS (SELECT m.*, t.gold AS primary_gold, t.junk AS primary_cut FROM members m JOIN tiers t ON t.track = primary_id),
fates AS (SELECT t.track, place, CASE WHEN track = primary_id OR t.gold OR primary_id IS NULL THEN 'keep' WHEN primary_gold THEN 'drop' WHEN primary_cut THEN 'keep' ELSE 'fold' END AS fate, primary_id
  FROM tiers t LEFT JOIN (SELECT track, place, primary_id, primary_gold, primary_cut FROM groups) g USING (track) WHERE NOT junk),
came AS (SELECT primary_id AS track, string_agg(track::VARCHAR, ',' ORDER BY place) AS stitched_from FROM fates WHERE fate = 'fold' GROUP BY primary_id),
own AS (SELECT CASE WHEN fate = 'fold' THEN primary_id ELSE f.track END AS track, f.track AS came_from, f.frame, f.t, f.t_us, f.observed, f.points, CASE WHEN fate = 'fold' THEN place ELSE -1 END AS rank FROM fragments f JOIN fates USING (track) WHERE fate <> 'drop'),
folded AS (SELECT * FROM own WHERE track NOT IN (SELECT track FROM came)
  UNION ALL SELECT * FROM own WHERE track IN (SELECT track FROM came) QUALIFY row_number() OVER (PARTITION BY track, t_us ORDER BY observed DESC, points DESC, rank, frame) = 1)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir).withColumn("anchor", F.col("kind") == "signup")
    return rows.withColumn("track", F.col("track") * 1000 + F.floor(F.col("t") / 5) % 1000)


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ends = written(stitching.track_ends(_fragments(spark, sf_dir), GATES), "track-ends")
    return stitching.continuation_edges(ends, GATES), ends


def _folded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folded frames, fates and members of the fragments that were not cut."""
    rows = _fragments(spark, sf_dir)
    members = written(stitching.members_of(stitching.proposals(*_edges(spark, sf_dir))), "members")
    tiers = rows.groupBy(F.col("track").alias("key")).agg(F.bool_or("anchor").alias("gold"), F.max("points").alias("most"))
    resolved = written(stitching.resolve(tiers.where("most >= 60").drop("most"), members), "fates")
    return stitching.fold(rows, resolved, members), resolved, members


@query(f"""WITH {FRAMES_SQL}, coarse AS (SELECT track, t_us // 43200000000 AS t_us, observed, points, frame % 3 AS rank, frame FROM frames)
SELECT track, t_us, observed, points, rank, frame FROM coarse QUALIFY row_number() OVER (PARTITION BY track, t_us ORDER BY observed DESC, points DESC, rank, frame) = 1""")
def frame_merge_dedupe(spark, sf_dir):
    coarse = frames(spark, sf_dir).select("track", F.floor(F.col("t_us") / 43_200_000_000).alias("t_us"), "observed", "points", (F.col("frame") % 3).alias("rank"), "frame")
    return stitching.merge_frames(coarse)


@query(f"WITH {FRAGMENTS_SQL} SELECT seq, track, follower, round(gap, 6) AS gap, round(residual, 6) AS residual, round(allowed, 6) AS allowed FROM edges")
def continuation_edges(spark, sf_dir):
    return rounded(_edges(spark, sf_dir)[0].drop("ends", "starts"))


@query(f"WITH RECURSIVE {CHAINS_SQL} SELECT * FROM chains")
def stitch_chains(spark, sf_dir):
    return stitching.chains(_edges(spark, sf_dir)[0])


@query(f"""WITH RECURSIVE {CHAINS_SQL} SELECT seq, chain, any_value(primary_id) AS primary_id, any_value(g.gold) AS primary_gold, string_agg(m.track::VARCHAR, ',' ORDER BY place) AS member_ids,
  string_agg(m.track::VARCHAR, ',' ORDER BY place) FILTER (m.track <> primary_id) AS fragment_ids, count(*) - 1 AS n_links FROM members m JOIN tiers g ON g.track = primary_id GROUP BY seq, chain""")
def stitch_proposals(spark, sf_dir):
    groups = stitching.proposals(*_edges(spark, sf_dir))
    ids = [F.concat_ws(",", F.col(c).cast("array<string>")).alias(c) for c in ("member_ids", "fragment_ids")]
    return groups.select("seq", "chain", "primary_id", "primary_gold", *ids, F.size("links").cast("long").alias("n_links"))


@query(f"""WITH RECURSIVE {CHAINS_SQL} SELECT c.seq, chain, place, l.track AS "from", l.follower AS "to", round(gap, 3) AS gap, round(residual, 3) AS residual, round(allowed, 3) AS allowed FROM links l JOIN chains c ON c.track = l.track""")
def stitch_evidence(spark, sf_dir):
    groups = stitching.proposals(*_edges(spark, sf_dir))
    return groups.select("seq", "chain", F.posexplode("links").alias("place", "link")).select("seq", "chain", "place", "link.*")


@query(f"WITH RECURSIVE {FOLD_SQL} SELECT track, came_from, frame, round(t, 6) AS t, observed, points FROM folded")
def folded_frames(spark, sf_dir):
    return rounded(_folded(spark, sf_dir)[0].select("track", "came_from", "frame", "t", "observed", "points"))


@query(f"""WITH RECURSIVE {FOLD_SQL} SELECT track, count(*) AS n_frames, count(*) FILTER (observed) AS n_observed, count(*) FILTER (NOT observed) AS n_coasted, round(avg(observed::INT), 4) AS observed_fraction, any_value(stitched_from) AS stitched_from
FROM folded LEFT JOIN came USING (track) GROUP BY track""")
def folded_tracks(spark, sf_dir):
    stats = stitching.fold_stats(*_folded(spark, sf_dir))
    return stats.withColumn("stitched_from", F.when(F.col("stitched_from").isNotNull(), F.concat_ws(",", F.col("stitched_from").cast("array<string>"))))


MOTION = tracking.Motion(nominal_dt=0.3, noise_position=5.0, noise_velocity=20.0, first_position=20.0, first_velocity=50.0, measurement=20.0)


#: Filter and smoother frame by frame: one covariance (p, q, r) for the three axes.
_NEXT = "CASE WHEN f.n = 1 OR f.t <= s.t THEN 0.3::DOUBLE ELSE f.t - s.t END"
KALMAN_SQL = f"""{FRAMES_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, frame) AS n FROM frames),
seed AS (SELECT track, coalesce(arg_min(x, n) FILTER (observed), arg_min(x, n)) AS x, coalesce(arg_min("y", n) FILTER (observed), arg_min("y", n)) AS y, coalesce(arg_min(z, n) FILTER (observed), arg_min(z, n)) AS z FROM f GROUP BY track),
forward AS (SELECT track, 0::BIGINT AS n, NULL::BIGINT AS frame, 0.0::DOUBLE AS t, x, y, z, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 400.0::DOUBLE AS p, 0.0::DOUBLE AS q, 2500.0::DOUBLE AS r,
    0.0::DOUBLE AS dt, x AS px, y AS py, z AS pz, 0.0::DOUBLE AS pvx, 0.0::DOUBLE AS pvy, 0.0::DOUBLE AS pvz, 0.0::DOUBLE AS pp, 0.0::DOUBLE AS pq, 0.0::DOUBLE AS pr, 0.0::DOUBLE AS confidence FROM seed
  UNION ALL SELECT track, n, frame, t, px + g * ox AS x, py + g * oy AS y, pz + g * oz AS z, pvx + h * ox AS vx, pvy + h * oy AS vy, pvz + h * oz AS vz, pp - g * pp AS p, pq - g * pq AS q, pr - h * pq AS r, dt, px, py, pz, pvx, pvy, pvz, pp, pq, pr,
    CASE WHEN observed THEN exp(-0.5::DOUBLE * least((ox * ox + oy * oy + oz * oz) / (pp + 400), 25.0::DOUBLE)) ELSE 0.0::DOUBLE END AS confidence
  FROM (SELECT *, CASE WHEN observed THEN pp / (pp + 400) ELSE 0.0::DOUBLE END AS g, CASE WHEN observed THEN pq / (pp + 400) ELSE 0.0::DOUBLE END AS h, zx - px AS ox, zy - py AS oy, zz - pz AS oz
    FROM (SELECT track, n, frame, t, observed, zx, zy, zz, dt, x + dt * vx AS px, y + dt * vy AS py, z + dt * vz AS pz, vx AS pvx, vy AS pvy, vz AS pvz,
        p + 2 * dt * q + dt * dt * r + 400 * dt * dt * dt * dt / 4 + 25 AS pp, q + dt * r + 400 * dt * dt * dt / 2 AS pq, r + 400 * dt * dt AS pr
      FROM (SELECT f.track, f.n, f.frame, f.t, f.observed, f.x AS zx, f."y" AS zy, f.z AS zz, s.x, s.y, s.z, s.vx, s.vy, s.vz, s.p, s.q, s.r, {_NEXT} AS dt FROM forward s JOIN f ON f.track = s.track AND f.n = s.n + 1)))),
size AS (SELECT track, max(n) AS n FROM f GROUP BY track),
back AS (SELECT w.track, w.n, w.frame, w.t, w.x, w.y, w.z, w.vx, w.vy, w.vz, w.confidence FROM forward w JOIN size USING (track, n)
  UNION ALL SELECT track, n, frame, t, x + a * ox + b * ovx AS x, y + a * oy + b * ovy AS y, z + a * oz + b * ovz AS z, vx + c * ox + d * ovx AS vx, vy + c * oy + d * ovy AS vy, vz + c * oz + d * ovz AS vz, confidence
  FROM (SELECT w.track, w.n, w.frame, w.t, w.x, w.y, w.z, w.vx, w.vy, w.vz, w.confidence, s.x - u.px AS ox, s.y - u.py AS oy, s.z - u.pz AS oz, s.vx - u.pvx AS ovx, s.vy - u.pvy AS ovy, s.vz - u.pvz AS ovz,
      ((w.p + w.q * u.dt) * u.pr - w.q * u.pq) / (u.pp * u.pr - u.pq * u.pq) AS a, (w.q * u.pp - (w.p + w.q * u.dt) * u.pq) / (u.pp * u.pr - u.pq * u.pq) AS b,
      ((w.q + w.r * u.dt) * u.pr - w.r * u.pq) / (u.pp * u.pr - u.pq * u.pq) AS c, (w.r * u.pp - (w.q + w.r * u.dt) * u.pq) / (u.pp * u.pr - u.pq * u.pq) AS d
    FROM back s JOIN forward u ON u.track = s.track AND u.n = s.n JOIN forward w ON w.track = s.track AND w.n = s.n - 1 AND w.n > 0))"""


@query(f"WITH RECURSIVE {KALMAN_SQL} SELECT track, frame, round(t, 3) AS t, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(confidence, 3) AS confidence FROM back")
def kalman_rts_tracks(spark, sf_dir):
    return rounded(tracking.smooth_tracks(frames(spark, sf_dir), MOTION), 3)


#: Days of a clip.
CLIP = 6


def _stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one sequence share a time step of a quarter day; a clip is six days of a sequence."""
    rows = frames(spark, sf_dir).withColumn("t", F.floor(F.col("t") * 4) / 4)
    place = [F.when(F.col("observed"), F.col(c)).alias(c) for c in tracking.AXES]
    return rows.select("seq", F.floor(F.col("t") / CLIP).alias("clip"), "track", "frame", "t", "kind", "points", *place)


@query()
def birth_tracks(spark, sf_dir):
    return rounded(tracking.born_tracks(_stepped(spark, sf_dir), MOTION, by=("seq", "clip")), 3)


@query()
def anchored_tracks(spark, sf_dir):
    """A signup is an anchor; the other frames of its sequence and clip are the pool."""
    rows = _stepped(spark, sf_dir).withColumn("seq", F.col("seq") * 100_000 + F.col("clip"))
    anchors = rows.where("kind = 'signup'").select("seq", F.col("frame").alias("key"), "t", *tracking.AXES)
    return rounded(tracking.anchored_tracks(rows.where("kind <> 'signup'"), anchors, MOTION), 3)


@query(f"""WITH {FRAMES_SQL}, s AS (SELECT seq, frame, floor(t * 4) / 4 AS step, t, kind FROM frames), p AS (SELECT DISTINCT seq, step AS pt FROM s WHERE kind <> 'signup'), l AS (SELECT * FROM s WHERE kind = 'signup'),
b AS (SELECT l.*, p.pt AS bt FROM l ASOF LEFT JOIN p ON l.seq = p.seq AND l.t >= p.pt), a AS (SELECT b.*, p.pt AS nt FROM b ASOF LEFT JOIN p ON b.seq = p.seq AND b.t < p.pt)
SELECT seq, frame AS key, round(CASE WHEN bt IS NULL THEN nt WHEN nt IS NULL OR t - bt <= nt - t THEN bt ELSE nt END, 6) AS frame_t, round(CASE WHEN bt IS NULL THEN nt - t WHEN nt IS NULL OR t - bt <= nt - t THEN t - bt ELSE nt - t END, 6) AS gap FROM a""")
def anchor_frames(spark, sf_dir):
    rows = frames(spark, sf_dir)
    pool = rows.where("kind <> 'signup'").select("seq", (F.floor(F.col("t") * 4) / 4).alias("t"))
    return rounded(tracking.anchor_frames(pool, rows.where("kind = 'signup'").select("seq", F.col("frame").alias("key"), "t")))


def _guarded_births(spark: SparkSession, sf_dir: str) -> guarded.Outcome:
    """Births that refuse a clip with a place beyond 490; the other clips go on."""
    born = tracking.born_in(("seq", "clip"), MOTION)

    def checked(own: pa.Table) -> pa.Table:
        n = pc.sum(pc.greater(own.column("x"), 490.0)).as_py() or 0
        if n:
            raise ValueError(f"{n} places out of range")
        return born(own.select(["seq", "clip", "t", *tracking.AXES]))

    rows = _stepped(spark, sf_dir)
    return guarded.apply(rows, ("seq", "clip"), checked, f"seq long, clip long, {tracking.BORN}")


@query(f"""WITH {FRAMES_SQL}, c AS (SELECT seq, CAST(floor(floor(t * 4) / 4 / {CLIP}) AS BIGINT) AS clip, count(*) FILTER (observed AND x > 490) AS n FROM frames GROUP BY 1, 2)
SELECT seq, clip, 'ValueError(''' || n || ' places out of range'')' AS error FROM c WHERE n > 0""")
def failed_clips(spark, sf_dir):
    return _guarded_births(spark, sf_dir).failures


@query()
def surviving_births(spark, sf_dir):
    return rounded(_guarded_births(spark, sf_dir).results, 3)


# ---- geometry -----------------------------------------------------------------------------------

POLYGON = ((-1.0, -1.0), (1.0, -1.2), (1.5, 0.8), (0.0, 0.2), (-1.2, 1.0))


def _polygon_sql(ring) -> str:
    terms = [f"(({ay} > y) <> ({by} > y) AND x < ({bx - ax}::DOUBLE * (y - {ay}::DOUBLE) / {by - ay + 1e-12!r}::DOUBLE + {ax}::DOUBLE))::INT" for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True)]
    return f"({' + '.join(terms)}) % 2 = 1"


@query(f"WITH {POINTS_SQL} SELECT vec_id, {_polygon_sql(POLYGON)} AS inside FROM points")
def point_in_polygon(spark, sf_dir):
    return points(spark, sf_dir).select("vec_id", G.inside(F.col("x"), F.col("y"), POLYGON).alias("inside"))


LENS = dict(k=(0.05, -0.01, 0.002, -0.0003), fx=900.0, fy=910.0, cx=960.0, cy=540.0)


@query(f"""WITH {POINTS_SQL}, a AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(sqrt(x * x + y * y), z) AS th FROM points),
b AS (SELECT *, th * (1.0 + th * th * (0.05 + th * th * (-0.01 + th * th * (0.002 + th * th * -0.0003)))) AS bent FROM a),
c AS (SELECT vec_id, z, CASE WHEN r < 1e-9 THEN 0.0 ELSE bent / greatest(r, 1e-9) END AS s, x, y FROM b),
d AS (SELECT vec_id, z, 900.0 * x * s + 960.0 AS u, 910.0 * y * s + 540.0 AS v FROM c)
SELECT vec_id, round(u, 5) AS u, round(v, 5) AS v, z > 0 AND u >= 0 AND u < 1920 AND v >= 0 AND v < 1080 AS visible FROM d""")
def fisheye_project(spark, sf_dir):
    u, v = G.fisheye(F.col("x"), F.col("y"), F.col("z"), **LENS)
    placed = points(spark, sf_dir).withColumns({"u": u, "v": v})
    return placed.select("vec_id", F.round("u", 5).alias("u"), F.round("v", 5).alias("v"), G.visible(F.col("u"), F.col("v"), F.col("z"), 1920, 1080).alias("visible"))


_CORNERS_SQL = ", ".join(f"{{'x': x + {a * 2.0} * cos(z) - {b * 1.0} * sin(z), 'y': y + {a * 2.0} * sin(z) + {b * 1.0} * cos(z)}}" for a in (1, -1) for b in (1, -1))


@query(f"""WITH {POINTS_SQL}, c AS (SELECT vec_id, [{_CORNERS_SQL}] AS k FROM points)
SELECT vec_id, round(k[1].x, 6) AS front_x, round(k[1].y, 6) AS front_y, round(list_min(list_transform(k, lambda p: p.x)), 6) AS x1, round(list_min(list_transform(k, lambda p: p.y)), 6) AS y1,
  round(list_max(list_transform(k, lambda p: p.x)), 6) AS x2, round(list_max(list_transform(k, lambda p: p.y)), 6) AS y2 FROM c""")
def box_corners_bbox(spark, sf_dir):
    c = G.corners(F.col("x"), F.col("y"), F.lit(0.0), F.lit(4.0), F.lit(2.0), F.lit(1.0), F.col("z"))
    at = lambda f, axis: f(F.transform("k", lambda p: p[axis]))
    rows = points(spark, sf_dir).withColumn("k", c)
    return rounded(rows.select("vec_id", F.col("k")[0]["x"].alias("front_x"), F.col("k")[0]["y"].alias("front_y"), at(F.array_min, "x").alias("x1"), at(F.array_min, "y").alias("y1"), at(F.array_max, "x").alias("x2"), at(F.array_max, "y").alias("y2")))


def _sides(spark: SparkSession, sf_dir: str, cut: str) -> tuple[DataFrame, DataFrame]:
    rows = points(spark, sf_dir)
    return (
        rows.where(f"not ({cut})").select(F.col("vec_id").alias("key"), "label", "x", "y"),
        rows.where(cut).select(F.col("vec_id").alias("other"), "label", F.col("x").alias("ox"), F.col("y").alias("oy")),
    )


DISTANCE_SQL = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


@query(f"WITH {POINTS_SQL} SELECT a.vec_id AS key, round(min({DISTANCE_SQL}), 6) AS distance FROM points a JOIN points b ON a.label = b.label AND b.vec_id % 5 = 0 WHERE a.vec_id % 5 <> 0 GROUP BY a.vec_id")
def min_surface_distance(spark, sf_dir):
    return rounded(spatial.nearest_distance(*_sides(spark, sf_dir, "vec_id % 5 = 0"), width=0.5, on=["label"]))


@query(f"""WITH {POINTS_SQL} SELECT vec_id AS key FROM points a WHERE vec_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM points b WHERE b.vec_id % 3 = 0 AND b.label = a.label AND {DISTANCE_SQL} <= 0.4)""")
def radius_anti_join(spark, sf_dir):
    return spatial.unclaimed(*_sides(spark, sf_dir, "vec_id % 3 = 0"), radius=0.4, on=["label"]).select("key")


@query(f"""WITH {POINTS_SQL}, a AS (SELECT * FROM points WHERE vec_id % 3 <> 0), p AS (SELECT a.vec_id AS key, b.vec_id AS other, {DISTANCE_SQL} AS distance FROM a JOIN points b ON a.label = b.label AND b.vec_id % 3 = 0 AND {DISTANCE_SQL} <= 0.5),
m AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY distance, other) = 1)
SELECT a.vec_id AS key, m.other, round(m.distance, 6) AS distance FROM a LEFT JOIN m ON m.key = a.vec_id""")
def gated_nearest(spark, sf_dir):
    return rounded(spatial.nearest_in_gate(*_sides(spark, sf_dir, "vec_id % 3 = 0"), gate=0.5, on=["label"]))


_PIXELS = "900.0 * x / (abs(z) + 5) + 960.0 AS u, 910.0 * y / (abs(z) + 5) + 540.0 AS v"


@query(f"""WITH {POINTS_SQL}, p AS (SELECT label AS scan, vec_id, x, y, z, {_PIXELS} FROM points),
b AS (SELECT scan, vec_id AS box, u - 250 AS x1, v - 250 AS y1, u + 250 AS x2, v + 250 AS y2 FROM p),
i AS (SELECT b.scan, b.box, p.x, p.y, p.z, sqrt(p.x * p.x + p.y * p.y) AS r FROM b JOIN p ON p.scan = b.scan
  AND p.u BETWEEN x1 + 0.2 * (x2 - x1) AND x2 - 0.2 * (x2 - x1) AND p.v BETWEEN y1 + 0.1 * (y2 - y1) AND y1 + 0.9 * (y2 - y1)),
n AS (SELECT scan, box, quantile_cont(r, 0.15) AS near, count(*) AS n_all FROM i GROUP BY scan, box),
m AS (SELECT i.*, r <= near + 1.5 AS s, n_all FROM i JOIN n USING (scan, box)),
l AS (SELECT scan, box, count(*) FILTER (s) AS k, any_value(n_all) AS n_all, median(x) FILTER (s) AS sx, median(y) FILTER (s) AS sy, median(z) FILTER (s) AS sz, median(x) AS ax, median(y) AS ay, median(z) AS az FROM m GROUP BY scan, box)
SELECT b.scan, b.box, round(CASE WHEN k >= 3 THEN sx ELSE ax END, 6) AS x, round(CASE WHEN k >= 3 THEN sy ELSE ay END, 6) AS y, round(CASE WHEN k >= 3 THEN sz ELSE az END, 6) AS z,
  CASE WHEN k >= 3 THEN k ELSE n_all END AS n_points FROM b LEFT JOIN (SELECT * FROM l WHERE n_all >= 3) l USING (scan, box)""")
def frustum_lift(spark, sf_dir):
    depth = F.abs("z") + 5
    p = points(spark, sf_dir).select(F.col("label").alias("scan"), "vec_id", "x", "y", "z", (900.0 * F.col("x") / depth + 960.0).alias("u"), (910.0 * F.col("y") / depth + 540.0).alias("v"))
    b = p.select("scan", F.col("vec_id").alias("box"), *[(F.col(c) + d).alias(n) for n, c, d in (("x1", "u", -250), ("y1", "v", -250), ("x2", "u", 250), ("y2", "v", 250))])
    return rounded(lifting.lift(p, b))


# ---- integrity, metrics, JSON -------------------------------------------------------------------


@query("""WITH listed AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS h FROM documents),
found AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'new-' ELSE '' END || CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END) AS h FROM documents WHERE doc_id % 7 <> 0),
j AS (SELECT coalesce(l.path, f.path) AS path, CASE WHEN f.h IS NULL THEN 'MISSING' WHEN l.h IS NULL THEN 'UNLISTED' WHEN l.h <> f.h THEN 'CHANGED' END AS problem FROM listed l FULL JOIN found f ON l.path = f.path)
SELECT * FROM j WHERE problem IS NOT NULL""")
def checksum_verify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    now = docs.where("doc_id % 7 <> 0").select(
        F.concat(F.when(F.col("doc_id") % 11 == 0, "new-").otherwise(""), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 5 == 0, "!").otherwise("")).alias("text"),
    )
    return integrity.verify(integrity.checksums(docs, "doc_id", "text"), integrity.checksums(now, "name", "text"))


SCORED_SQL = "scored AS (SELECT quality AS label, (n_chars % 97) / 97.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"""WITH {SCORED_SQL}, r AS (SELECT label, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS k FROM scored),
s AS (SELECT score, sum(label) AS p, count(*) AS n FROM scored GROUP BY score),
c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS seen FROM s),
t AS (SELECT sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM scored)
SELECT round(((SELECT sum(k) FROM r WHERE label = 1) - t.p * (t.p + 1) / 2) / (t.p * (t.n - t.p)), 6) AS roc_auc, round((SELECT sum(p * tp / seen) FROM c) / t.p, 6) AS average_precision,
  round(greatest(t.p / t.n, 1 - t.p / t.n), 6) AS majority_accuracy, round(t.p / t.n, 6) AS positive_rate FROM t""")
def roc_auc_ap(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    scored = labels.where("quality is not null").join(docs.select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") % 97 / 97.0).alias("score"))
    return rounded(scoring.ranking_metrics(scored))


@query("""SELECT quality, count(*) FILTER (toxic = 1) AS n_positive, count(*) FILTER (toxic = 0) AS n_negative, round(count(*) FILTER (toxic = 0) / greatest(count(*) FILTER (toxic = 1), 1), 6) AS weight FROM labels GROUP BY quality""")
def class_imbalance(spark, sf_dir):
    return rounded(scoring.imbalance(table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label"), ["quality"]))


@query("""WITH runs AS (SELECT doc_id % 5 AS seed, quality, avg(toxic) AS rate FROM labels GROUP BY doc_id % 5, quality)
SELECT quality, count(rate) AS n_runs, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS deviation FROM runs GROUP BY quality""")
def imbalance_and_seed_stats(spark, sf_dir):
    runs = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 5).alias("seed"), "quality").agg(F.avg("toxic").alias("rate"))
    return rounded(scoring.over_seeds(runs, ["quality"], "rate"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(props->>'k' AS INT)) AS BIGINT) AS k, CAST(max(CAST(props->>'k' AS INT)) AS INT) AS k_max FROM events GROUP BY event_type")
def json_props_extract(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"), F.max("p.k").alias("k_max"))


@query("""WITH s AS (SELECT conv_id, turn, role, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS fresh FROM conversations)
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (fresh) AS n_runs FROM s GROUP BY conv_id""")
def role_runs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.select("conv_id", (~F.col("role").eqNullSafe(before)).alias("fresh")).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if("fresh").alias("n_runs"))




# ---- streams ------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start_us + 21600000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)""")
def streaming_windowed_counts(spark, sf_dir):
    counts = online.windowed_counts(online.event_stream(spark, f"{sf_dir}/events.parquet"), "6 hours", "1 hour")
    return rounded(online.drained(counts, "stream"), 4)


@query("""WITH e AS (SELECT epoch_us(ts) AS us, event_type FROM events), w AS (SELECT us // 21600000000 * 21600000000 - 21600000000 * k AS start_us, event_type FROM e, (VALUES (0), (1)) s(k)),
g AS (SELECT start_us, event_type, count(*) AS n FROM w GROUP BY 1, 2) SELECT * FROM g WHERE start_us + 43200000000 <= (SELECT max(us) - 3600000000 FROM e)""")
def streaming_sliding_counts(spark, sf_dir):
    counts = online.windowed_counts(online.event_stream(spark, f"{sf_dir}/events.parquet"), "12 hours", "1 hour", slide="6 hours")
    return online.drained(counts, "sliding").drop("total")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), b AS (SELECT *, coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us) >= 43200000000, true) AS fresh FROM e),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY us) AS place FROM b), g AS (SELECT user_id, min(us) AS start_us, max(us) + 43200000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, place)
SELECT * FROM g WHERE end_us <= (SELECT max(us) - 3600000000 FROM e)""")
def streaming_sessions(spark, sf_dir):
    return online.drained(online.sessions(online.event_stream(spark, f"{sf_dir}/events.parquet"), "12 hours", "1 hour"), "sessions")


def _births_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A step is a quarter day, a clip six days of a sequence; the watermark is a quarter day behind."""
    events = online.event_stream(spark, f"{sf_dir}/events.parquet")
    seen, day = F.col("event_type") != "error", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400_000_000.0)
    step = F.floor(day * 4) / 4
    clip = F.floor(step / CLIP)
    moment = lambda days: F.timestamp_micros((days * F.lit(86_400_000_000.0)).cast("long"))
    times = [step.alias("t"), moment(step + 0.25).alias("closes"), moment((clip + 1) * CLIP).alias("ends")]
    k = F.get_json_object("props", "$.k").cast("double")
    place = [F.when(seen, c).alias(n) for n, c in (("x", F.col("value")), ("y", k), ("z", F.col("value") / 8))]
    stepped = events.select(F.floor(F.col("user_id") / 50).alias("seq"), clip.alias("clip"), *times, *place)
    return online.all_born(stepped, MOTION, "6 hours", by=("seq", "clip"))


@query()
def streaming_births(spark, sf_dir):
    """Rows of all tracks; `streamed` tells those that left the stream itself from those still held when it ended."""
    streamed, rest = _births_stream(spark, sf_dir)
    return rounded(streamed.withColumn("streamed", F.lit(True)).unionByName(rest.withColumn("streamed", F.lit(False))), 3)


from . import assembled, sensed, spaces, stored  # noqa: E402,F401  the other registered queries
