"""Registered queries of the sample pipeline and of what reports and readers need; see `catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import METRICS_SQL, _quality, query, rounded
from .functions.time import sequence_key
from .operators import actions, assembly, blocks, poses, quality, splits, stats, stitching, temporal
from .plans.adapters import FRAMES_SQL, SAMPLES_SQL, SENSORS_SQL, frames, samples, sensors, table
from .session import written
from .sources import documents, index

# ---- actions and samples ------------------------------------------------------------------------

ON_ROAD, KNOWN_ROAD = "x > 150", "track % 9 <> 4"
CONFIG = assembly.Assembly(length=3.0, ego_distance=90.0, road_distance=60.0, scans=3)

ACTIONS_SQL = f"""{FRAMES_SQL},
own AS (SELECT seq, track, count(*) AS n_frames, count(*) FILTER (observed AND points >= 0) AS n_real, count(*) FILTER ({ON_ROAD} AND {KNOWN_ROAD}) AS hits, bool_or({KNOWN_ROAD}) AS known,
  arg_min(t, (t, frame)) FILTER ({ON_ROAD} AND {KNOWN_ROAD}) AS first_t, arg_min(observed, (t, frame)) FILTER ({ON_ROAD} AND {KNOWN_ROAD}) AS first_observed, min(t) AS t0, max(t) AS t1 FROM frames GROUP BY seq, track),
actions AS (SELECT seq, track, CASE WHEN n_real > 0 THEN 'determined' ELSE 'undetermined' END AS status, CASE WHEN n_real > 0 AND known THEN hits > 0 END AS crosses,
  CASE WHEN n_real > 0 THEN first_t END AS crossing_t, CASE WHEN n_real > 0 THEN first_observed END AS crossing_observed, n_frames, n_real, CASE WHEN n_real > 0 AND known THEN hits ELSE 0 END AS road_frames, t0, t1 FROM own)"""


def _actions(rows: DataFrame) -> DataFrame:
    return actions.label_actions(rows, F.expr(ON_ROAD), F.expr(KNOWN_ROAD))


@query(f"WITH {ACTIONS_SQL} SELECT * EXCLUDE (crossing_t, t0, t1), round(crossing_t, 6) AS crossing_t, round(t0, 6) AS t0, round(t1, 6) AS t1 FROM actions")
def action_records(spark, sf_dir):
    return rounded(_actions(frames(spark, sf_dir)))


@query(f"""WITH {ACTIONS_SQL} SELECT count(*) AS n_tracks, count(*) FILTER (status = 'determined') AS n_determined, count(*) FILTER (status = 'undetermined') AS n_undetermined,
  count(*) FILTER (crosses) AS n_crossing, round(count(*) FILTER (crosses) / count(*) FILTER (status = 'determined'), 6) AS crossing_rate FROM actions""")
def action_summary(spark, sf_dir):
    return rounded(actions.summary(_actions(frames(spark, sf_dir))))


L, ROAD = CONFIG.length, "abs(x - 50)"
#: The vehicle drives along: its place at a moment.
EGO = ("40.0 + mid / 1000", "50.0")
ASSEMBLED_SQL = f"""{ACTIONS_SQL}, {SENSORS_SQL},
judged AS (SELECT *, CASE WHEN track % 17 = 3 THEN 'no_action_record' WHEN status <> 'determined' THEN 'undetermined_action' WHEN crosses IS NULL THEN 'unlabeled_no_ego_road' WHEN track % 11 = 5 THEN 'no_road_surface_points' END AS reason FROM actions),
passing AS (SELECT * FROM judged WHERE reason IS NULL),
horizons AS (SELECT p.track, p.seq, h.place, h.horizon, crossing_t - h.horizon AS "end", crossing_t - h.horizon - {L}::DOUBLE AS start, crossing_t AS onset_t, crossing_observed AS onset_observed, t0, t1
  FROM passing p, (VALUES (0, 1.0::DOUBLE), (1, 1.5), (2, 2.0)) h(place, horizon) WHERE crosses),
tte AS (SELECT track, seq, 'tte_anchored' AS kind, horizon, start, "end", onset_t, onset_observed, CASE WHEN NOT (start >= t0 - 0.0001 AND "end" <= t1 + 0.0001) THEN 'window_outside_track' END AS reason
  FROM horizons QUALIFY row_number() OVER (PARTITION BY track, floor(start * 1000 + 0.5) ORDER BY place DESC) = 1),
calm AS (SELECT f.*, p.t0, p.t1 FROM frames f JOIN passing p USING (track) WHERE NOT p.crosses),
ending AS (SELECT track, frame, t AS moment, {ROAD} AS distance, least(greatest(t, t0 + {L}), t1) AS "end" FROM calm WHERE observed AND t1 - t0 >= {L} - 0.0001),
share AS (SELECT e.track, e.frame, any_value(moment) AS moment, any_value(distance) AS distance, any_value("end") AS "end", avg(c.observed::INT) AS fraction FROM ending e JOIN calm c ON c.track = e.track AND c.t >= "end" - {L} - 0.0001 AND c.t <= "end" + 0.0001 GROUP BY e.track, e.frame),
best AS (SELECT * FROM share WHERE fraction >= {CONFIG.observed} QUALIFY row_number() OVER (PARTITION BY track ORDER BY distance, moment, frame) = 1),
closest AS (SELECT p.track, p.seq, 'closest_approach' AS kind, NULL::DOUBLE AS horizon, "end" - {L}::DOUBLE AS start, "end", NULL::DOUBLE AS onset_t, NULL::BOOLEAN AS onset_observed,
  CASE WHEN t1 - t0 < {L} - 0.0001 THEN 'window_outside_track' WHEN b.track IS NULL THEN 'comparison_window_unobserved' END AS reason FROM passing p LEFT JOIN best b USING (track) WHERE NOT crosses),
proposed AS (SELECT *, CAST(floor(start * 1000 + 0.5) AS BIGINT) AS "window", (start + "end") / 2 AS mid FROM (SELECT * FROM tte UNION ALL SELECT * FROM closest)),
good AS (SELECT * EXCLUDE (reason) FROM proposed WHERE reason IS NULL),
b AS (SELECT g.*, r.t AS bt, r.x AS bx, r."y" AS b_y FROM good g ASOF LEFT JOIN frames r ON g.track = r.track AND g.mid >= r.t),
a AS (SELECT b.*, r.t AS nt, r.x AS ax, r."y" AS a_y FROM b ASOF LEFT JOIN frames r ON b.track = r.track AND b.mid < r.t),
placed AS (SELECT *, CASE WHEN bt IS NULL THEN ax WHEN nt IS NULL OR bt = mid THEN bx ELSE bx + (mid - bt) / (nt - bt) * (ax - bx) END AS x, CASE WHEN bt IS NULL THEN a_y WHEN nt IS NULL OR bt = mid THEN b_y ELSE b_y + (mid - bt) / (nt - bt) * (a_y - b_y) END AS py FROM a),
near AS (SELECT g.track, g."window", count(*) FILTER (sensor = 'lidar') AS n_lidar, count(*) FILTER (sensor = 'camera') AS n_camera FROM good g LEFT JOIN sensors s ON s.seq = g.seq AND s.t >= g.start - 0.0001 AND s.t <= g."end" + 0.0001 GROUP BY 1, 2),
seen AS (SELECT g.track, g."window", avg(f.observed::INT) AS fraction FROM good g LEFT JOIN frames f ON f.track = g.track AND f.t >= g.start - 0.0001 AND f.t <= g."end" + 0.0001 GROUP BY 1, 2),
sized AS (SELECT p.*, n_lidar, n_camera, fraction, sqrt(power(x - ({EGO[0]}), 2) + power(py - ({EGO[1]}), 2)) AS ego, {ROAD} AS road FROM placed p JOIN near USING (track, "window") JOIN seen USING (track, "window")),
gated AS (SELECT *, CASE WHEN ego > {CONFIG.ego_distance} THEN 'distance_to_ego' WHEN road > {CONFIG.road_distance} THEN 'distance_to_road' WHEN n_lidar < {CONFIG.scans} THEN 'lidar_availability' WHEN n_camera = 0 THEN 'camera_availability' WHEN fraction IS NULL THEN 'no_track_frames' END AS reason,
  {", ".join(f'''CASE WHEN onset_t >= "end" - 0.0001 AND onset_t <= "end" + {h}::DOUBLE + 0.0001 THEN 'crossing' ELSE 'not_crossing' END AS intent_{n}''' for h, n in (('1.0', 'h1_0'), ('1.5', 'h1_5'), ('2.0', 'h2_0'), ('horizon', 'own')))} FROM sized),
samples AS (SELECT seq, track, "window", kind, horizon, start, "end", intent_own AS intent, intent_h1_0, intent_h1_5, intent_h2_0,
  round(fraction * CASE WHEN intent_own = 'crossing' AND NOT onset_observed THEN 0.6 WHEN intent_own <> 'crossing' AND road < 1.0 THEN 0.7 ELSE 1.0 END, 3) AS confidence,
  round(ego, 2) AS distance_to_ego, round(road, 2) AS distance_to_road, round(fraction, 3) AS observed_fraction, n_lidar, n_camera, reason FROM gated)"""


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventeenth track has no action record."""
    rows = written(frames(spark, sf_dir), "frames")
    records = actions.with_actions(rows.select("seq", "track").distinct(), _actions(rows).where("track % 17 <> 3"))
    return assembly.assemble(rows, records, sensors(spark, sf_dir), F.expr(ROAD), (F.expr(EGO[0]), F.expr(EGO[1])), F.col("track") % 11 != 5, CONFIG)


@query(f"""WITH {ASSEMBLED_SQL} SELECT seq || '_' || track || '_' || "window" AS sample_id, * EXCLUDE (reason, start, "end"), round(start, 6) AS start, round("end", 6) AS "end" FROM samples WHERE reason IS NULL""")
def assembled_samples(spark, sf_dir):
    return rounded(assembly.samples(_assembled(spark, sf_dir)).drop("reason"))


@query(f"""WITH {ASSEMBLED_SQL} SELECT reason, count(*) AS n FROM (SELECT reason FROM judged UNION ALL SELECT reason FROM proposed UNION ALL SELECT reason FROM samples) WHERE reason IS NOT NULL GROUP BY reason""")
def assembly_skips(spark, sf_dir):
    return assembly.skips(_assembled(spark, sf_dir))


@query(f"""WITH {ASSEMBLED_SQL}, kept AS (SELECT * FROM samples WHERE reason IS NULL) SELECT count(*) AS n_samples, count(*) FILTER (kind = 'tte_anchored') AS n_tte_anchored, count(*) FILTER (kind = 'closest_approach') AS n_closest_approach,
  count(DISTINCT (seq, track)) AS n_pedestrians, {", ".join(f"count(*) FILTER (intent_{h} = 'crossing') AS crossing_{h}, round(count(*) FILTER (intent_{h} = 'crossing') / count(*), 4) AS ratio_{h}" for h in ("h1_0", "h1_5", "h2_0"))} FROM kept""")
def sample_summary(spark, sf_dir):
    return assembly.summary(assembly.samples(_assembled(spark, sf_dir)))


# ---- blocks of samples -------------------------------------------------------------------------

#: The vehicle at a moment: it drives along x and turns by a tenth of a radian a day.
_POSE = "array(cos(start / 10), -sin(start / 10), 0D, 40D + start / 1000, sin(start / 10), cos(start / 10), 0D, 50D, 0D, 0D, 1D, 0D, 0D, 0D, 0D, 1D)"
SAMPLED_SQL = f"""{ASSEMBLED_SQL}, s AS (SELECT seq || '_' || track || '_' || "window" AS sample_id, seq, track, start, "end" FROM samples WHERE reason IS NULL)"""


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(assembly.samples(_assembled(spark, sf_dir)).select("sample_id", "seq", "track", "start", "end"), "samples")


@query(f"""WITH {SAMPLED_SQL} SELECT sample_id, f.frame, round(f.t, 6) AS t, f.t <= s."end" + 0.0001 AS observed_part, round(f.x, 4) AS x, round(f."y", 4) AS y,
  round(cos(start / 10) * (f.x - 40 - start / 1000) + sin(start / 10) * (f."y" - 50), 4) AS ego_x, round(-sin(start / 10) * (f.x - 40 - start / 1000) + cos(start / 10) * (f."y" - 50), 4) AS ego_y
FROM s JOIN frames f ON f.track = s.track AND f.t >= start - 0.0001 AND f.t <= s."end" + 2.0001""")
def sample_trajectories(spark, sf_dir):
    """Frames of the trajectory blocks, one a row; `observed_part` tells input from target."""
    own = _sampled(spark, sf_dir)
    block = blocks.trajectory(own, frames(spark, sf_dir), own.select("sample_id", F.expr(_POSE).alias("pose")), ahead=2.0)
    rows = blocks.assembled(own, block).select("sample_id", "end", F.explode("frames").alias("f"))
    at = lambda c, i: F.round(F.col(f"f.{c}")[i], 4)
    return rows.select("sample_id", "f.frame", F.round("f.ts", 6).alias("t"), (F.col("f.ts") <= F.col("end") + 0.0001).alias("observed_part"), at("position", 0).alias("x"), at("position", 1).alias("y"), at("position_ego_rel", 0).alias("ego_x"), at("position_ego_rel", 1).alias("ego_y"))


@query(f"""WITH {SAMPLED_SQL}, around AS (SELECT sample_id, f.frame, f.kind, f.t, f.track = s.track AND f.observed AS boxed, f.x FROM s JOIN frames f ON f.seq = s.seq AND f.kind IN ('view', 'click', 'purchase') AND f.t >= start - 0.0001 AND f.t <= s."end" + 0.0001)
SELECT s.sample_id, count(n.frame) FILTER (kind = 'view') AS n_lidar, count(n.frame) FILTER (kind <> 'view') AS n_camera, count(n.frame) FILTER (kind <> 'view' AND boxed) AS n_boxes,
  arg_min(n.frame::VARCHAR || '.jpg', (n.t, n.frame)) FILTER (kind <> 'view') AS first_image, round(sum(x - 5) FILTER (kind <> 'view' AND boxed), 4) AS left_edges FROM s LEFT JOIN around n USING (sample_id) GROUP BY s.sample_id""")
def sample_media(spark, sf_dir):
    """Images and scans of each sample; a track's box is known in the images that are events of its own."""
    rows = frames(spark, sf_dir)
    path = F.concat(F.col("frame").cast("string"), F.when(F.col("kind") == "view", ".npy").otherwise(".jpg"))
    records = rows.where("kind in ('view', 'click', 'purchase')").select("seq", "t", F.when(F.col("kind") == "view", "lidar").otherwise("camera").alias("sensor"), path.alias("path"))
    boxed = rows.where("observed and kind in ('click', 'purchase')").select("track", "t", F.array(F.col("x") - 5, F.col("y"), F.col("x") + 5, F.col("y") + 20).alias("bbox")).dropDuplicates(["track", "t"])
    own = blocks.media(_sampled(spark, sf_dir), records, boxed)
    seen = F.filter(index.boxes(F.col("camera_frames")), lambda b: b.isNotNull())
    edges = F.aggregate(seen, F.lit(0.0), lambda a, b: a + b[0])
    return own.select("sample_id", F.size("lidar_scans").cast("long").alias("n_lidar"), F.size("camera_frames").cast("long").alias("n_camera"), F.size(seen).cast("long").alias("n_boxes"), F.get("camera_frames", F.lit(0))["path"].alias("first_image"), F.when(F.size(seen) > 0, F.round(edges, 4)).alias("left_edges"))


@query(f"""WITH {SAMPLED_SQL}, speed AS (SELECT seq, t, any_value(points) AS value FROM (SELECT * FROM frames WHERE kind = 'view' QUALIFY count(*) OVER (PARTITION BY seq, t) = 1) GROUP BY seq, t),
sb AS (SELECT s.*, v.t AS bt, v.value AS bv FROM s ASOF LEFT JOIN speed v ON s.seq = v.seq AND s.start >= v.t), sa AS (SELECT sb.*, v.t AS nt, v.value AS nv FROM sb ASOF LEFT JOIN speed v ON sb.seq = v.seq AND sb.start < v.t),
scene AS (SELECT seq, count(DISTINCT track) AS n FROM frames GROUP BY seq), foremost AS (SELECT seq, track FROM (SELECT seq, track, min({ROAD}) AS d FROM frames GROUP BY seq, track) QUALIFY row_number() OVER (PARTITION BY seq ORDER BY d, track) = 1)
SELECT sample_id, CASE WHEN bt IS NULL THEN nv WHEN nt IS NULL OR start - bt <= nt - start THEN bv ELSE nv END AS ego_speed, n AS num_pedestrians_in_scene, coalesce(sa.track = c.track, false) AS is_key_pedestrian, s_name AS location
FROM sa LEFT JOIN scene USING (seq) LEFT JOIN foremost c ON c.seq = sa.seq LEFT JOIN supplier ON s_suppkey = sa.seq""")
def sample_context(spark, sf_dir):
    """The signal nearest to the window's start, and what is known of the sequence."""
    rows, own = frames(spark, sf_dir), _sampled(spark, sf_dir)
    single = rows.where("kind = 'view'").groupBy("seq", "t").agg(F.count("*").alias("n"), F.first("points").alias("value")).where("n = 1")
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("location"))
    found = blocks.assembled(own, blocks.context(own, {"ego_speed": single}), blocks.metadata(own, rows, F.expr(ROAD), places))
    return found.select("sample_id", "ego_speed", "num_pedestrians_in_scene", "is_key_pedestrian", "location")


@query(f"WITH {ACTIONS_SQL} SELECT seq, track, status, crosses FROM actions WHERE track IN (SELECT track FROM frames WHERE kind = 'purchase')")
def rendered_actions(spark, sf_dir):
    """Records of the tracks with a purchase only."""
    rows = frames(spark, sf_dir)
    return actions.only_for(_actions(rows), rows.where("kind = 'purchase'")).select("seq", "track", "status", "crosses")


# ---- reports on tracks --------------------------------------------------------------------------

PATHS_SQL = f"""{METRICS_SQL},
seen AS (SELECT track, {{step}} AS step FROM (SELECT * FROM frames WHERE observed) WINDOW w AS (PARTITION BY track ORDER BY t, frame)),
paths AS (SELECT track, count(*) AS n_seen, coalesce(sum(step), 0.0) AS path, coalesce(max(step), 0.0) AS longest_step FROM seen GROUP BY track)"""
PATHS_SQL = PATHS_SQL.replace("{step}", "sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2))")


@query(f"WITH {PATHS_SQL} SELECT track, n_seen AS n_observed, round(path, 4) AS path, round(longest_step, 6) AS longest_step, longest_step > 200 AS jump FROM paths")
def observed_paths(spark, sf_dir):
    own = temporal.paths(frames(spark, sf_dir)).withColumn("jump", F.col("longest_step") > 200)
    return own.select("track", "n_observed", F.round("path", 4).alias("path"), F.round("longest_step", 6).alias("longest_step"), "jump")


@query(f"""WITH {PATHS_SQL}, gaps AS (SELECT track, max(n_frames) AS gap_frames FROM runs WHERE internal GROUP BY track)
SELECT m.track, round(observed_fraction, 6) AS observed_fraction, round(path, 4) AS path, gap_frames FROM metrics m JOIN paths USING (track) JOIN gaps g USING (track)
WHERE gap_frames >= 2 AND observed_fraction >= 0.75 AND path >= 100 AND longest_step <= 330 ORDER BY gap_frames DESC, paths.path DESC, m.track LIMIT 20""")
def demo_ranking(spark, sf_dir):
    rows = frames(spark, sf_dir)
    found = quality.demo_tracks(temporal.paths(rows), temporal.longest_bridged(rows), _quality(spark, sf_dir), observed=0.75, path=100.0, step=330.0)
    return found.select("track", F.round("observed_fraction", 6).alias("observed_fraction"), F.round("path", 4).alias("path"), "gap_frames")


@query(f"""WITH {METRICS_SQL}, rolled AS (SELECT seq, avg((tier = 'good')::INT) AS good_fraction FROM tracks GROUP BY seq)
SELECT 'cleanest' AS "end", seq, round(good_fraction, 6) AS good_fraction FROM (SELECT * FROM rolled ORDER BY good_fraction DESC, seq LIMIT 5)
UNION ALL SELECT 'roughest', seq, round(good_fraction, 6) FROM (SELECT * FROM rolled ORDER BY good_fraction, seq LIMIT 5)""")
def cleanest_and_roughest(spark, sf_dir):
    return rounded(quality.extremes(quality.rollup(_quality(spark, sf_dir)), 5))


@query(f"""WITH {METRICS_SQL}, pool AS (SELECT seq, count(DISTINCT t_us // 3600000000) AS n_pool FROM frames WHERE seq % 5 <> 2 GROUP BY seq)
SELECT track, round(n_frames / n_pool, 6) AS span_fraction FROM tracks LEFT JOIN pool USING (seq)""")
def span_fractions(spark, sf_dir):
    """The pool's frames are the hours in which anything was seen; some sequences have no report of theirs."""
    pool = frames(spark, sf_dir).where("seq % 5 <> 2").groupBy("seq").agg(F.count_distinct(F.floor(F.col("t_us") / 3_600_000_000)).alias("n_pool"))
    return rounded(quality.with_span(_quality(spark, sf_dir), pool).select("track", "span_fraction"))


@query(f"""WITH {METRICS_SQL}, kinds AS (SELECT track, arg_min(kind, (t, frame)) AS occlusion FROM frames GROUP BY track)
SELECT occlusion, count(*) AS n_tracks, round(avg(coverage), 6) AS coverage FROM tracks JOIN kinds USING (track) GROUP BY occlusion""")
def coverage_by_occlusion(spark, sf_dir):
    kinds = frames(spark, sf_dir).groupBy("track").agg(F.min_by("kind", F.struct("t", "frame")).alias("occlusion"))
    return rounded(quality.mean_coverage(_quality(spark, sf_dir).join(kinds, "track"), "occlusion"))


# ---- keys, roles, splits, schedules -------------------------------------------------------------


@query("SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 6, '0') AS sequence, coalesce(lang, '') || '_' || coalesce(source, '') AS pedestrian FROM documents")
def file_keys(spark, sf_dir):
    """Names of track documents taken apart: the sequence up to the first underscore, the pedestrian after it."""
    name = F.concat(sequence_key(F.col("doc_id").cast("string")), F.lit("_"), F.coalesce("lang", F.lit("")), F.lit("_"), F.coalesce("source", F.lit("")), F.lit(".json"))
    sequence, pedestrian = documents.key_of_file(name)
    return table(spark, sf_dir, "documents").select("doc_id", sequence.alias("sequence"), pedestrian.alias("pedestrian"))


@query("""WITH tracks AS (SELECT doc_id AS key, n_chars % 3 = 0 AS gold, doc_id // 4 AS chain, doc_id % 4 = 0 AS main FROM documents WHERE n_chars % 19 <> 0),
mains AS (SELECT doc_id // 4 AS chain, doc_id AS main_key, n_chars % 3 = 0 AS main_gold, n_chars % 19 = 0 AS main_cut FROM documents WHERE doc_id % 4 = 0),
fates AS (SELECT key, gold, CASE WHEN main OR gold THEN 'keep' WHEN main_gold THEN 'drop' WHEN main_cut THEN 'keep' ELSE 'fold' END AS fate, main_key FROM tracks JOIN mains USING (chain))
SELECT key, gold, fate, CASE WHEN fate = 'fold' THEN main_key END AS "into" FROM fates""")
def resolved_tracks(spark, sf_dir):
    """Tracks after the cut (every nineteenth length), with what becomes of them in groups of four ids; the groups know whether their primary was gold."""
    n, key = F.col("n_chars"), F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    cut = docs.where(n % 19 == 0).select(key.alias("key"))
    tracks = docs.select(key.alias("key"), (n % 3 == 0).alias("gold")).join(cut, "key", "left_anti")
    tier = docs.where(key % 4 == 0).select(F.floor(key / 4).alias("chain"), (n % 3 == 0).alias("primary_gold"))
    members = docs.select(F.floor(key / 4).alias("chain"), key.alias("key"), (key % 4 == 0).alias("primary")).join(tier, "chain")
    return stitching.resolve(tracks, members)


@query("""WITH known AS (SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM supplier WHERE s_suppkey % 3 <> 1),
wanted AS (SELECT s_suppkey AS seq FROM supplier UNION SELECT l_suppkey + 5 FROM lineitem)
SELECT seq, split, split IS NULL AS fresh FROM wanted LEFT JOIN known USING (seq)""")
def inherited_splits(spark, sf_dir):
    """Sequences of the working set and of the samples with the split that is frozen for them; fresh ones have none yet."""
    own = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier")
    known = suppliers.where(own % 3 != 1).select(own.alias("seq"), F.when(own % 10 < 7, "train").when(own % 10 == 7, "val").otherwise("test").alias("split"))
    wanted = splits.working_set(suppliers.select(own.alias("seq")), table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 5).alias("seq")))
    return splits.inherit(wanted, known)


@query(f"""WITH {FRAMES_SQL}, l AS (SELECT * FROM frames WHERE kind = 'purchase'), r AS (SELECT * FROM frames WHERE kind <> 'purchase'),
b AS (SELECT l.track, l.frame, l.t, r.t AS bt, r.kind AS bv FROM l ASOF LEFT JOIN r ON l.track = r.track AND l.t >= r.t),
a AS (SELECT b.*, r.t AS nt, r.kind AS av FROM b ASOF LEFT JOIN r ON b.track = r.track AND b.t < r.t)
SELECT track, frame, CASE WHEN nt IS NULL OR t - bt <= nt - t THEN bv ELSE av END AS signal, round(CASE WHEN nt IS NULL OR t - bt <= nt - t THEN t - bt ELSE nt - t END, 6) AS gap FROM a""")
def signals_at_times(spark, sf_dir):
    """The categorical signal nearest to each moment, without a tolerance."""
    rows = frames(spark, sf_dir)
    found = temporal.asof_nearest(rows.where("kind = 'purchase'"), rows.where("kind <> 'purchase'"), F.col("kind"))
    return rounded(found.select("track", "frame", F.col("match_value").alias("signal"), "gap"))


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT seq, t - lag(t) OVER (PARTITION BY seq ORDER BY t, frame) AS gap FROM frames)
SELECT seq, count(*) AS n_records, round(max(gap), 6) AS longest_gap, coalesce(max(gap) <= 0.5, true) AS steady FROM g GROUP BY seq""")
def sensor_gaps(spark, sf_dir):
    return rounded(temporal.gaps(frames(spark, sf_dir), "seq", 0.5))


@query(f"""WITH {FRAMES_SQL}, k AS (SELECT track, (min(t) + max(t)) / 2 AS moment FROM frames GROUP BY track),
s AS (SELECT f.track, f.frame, f.t FROM frames f JOIN k USING (track) WHERE kind = 'view' AND abs(f.t - moment) <= 5), i AS (SELECT * FROM frames WHERE kind = 'click'),
b AS (SELECT s.*, i.t AS bt, i.frame AS bf FROM s ASOF LEFT JOIN i ON s.track = i.track AND s.t >= i.t), a AS (SELECT b.*, i.t AS nt, i.frame AS nf FROM b ASOF LEFT JOIN i ON b.track = i.track AND b.t < i.t)
SELECT track, frame, CASE WHEN bt IS NULL THEN nf WHEN nt IS NULL OR t - bt <= nt - t THEN bf ELSE nf END AS image FROM a""")
def frame_schedule(spark, sf_dir):
    """Scans around each track's middle, each with the nearest image."""
    rows = frames(spark, sf_dir)
    middle = rows.groupBy("track").agg(((F.min("t") + F.max("t")) / 2).alias("moment"))
    scans = rows.where("kind = 'view'").join(middle, "track").where(F.abs(F.col("t") - F.col("moment")) <= 5)
    return temporal.asof_nearest(scans, rows.where("kind = 'click'"), F.col("frame")).select("track", "frame", F.col("match_value").alias("image"))


# ---- what bundles and renderers say -------------------------------------------------------------


@query(f"""WITH {SAMPLES_SQL}, h AS (SELECT s.*, v.horizon, v.hit FROM samples s, LATERAL (VALUES ('1.0', h1_0), ('1.5', h1_5), ('2.0', h2_0)) v(horizon, hit))
SELECT horizon, CAST(GROUPING_ID(tier, split) AS INT) AS level, tier, split, count(*) AS samples, count(DISTINCT (seq, pedestrian)) AS pedestrians, count(DISTINCT seq) AS sequences,
  count(*) FILTER (hit) AS crossers, round(avg(hit::INT), 6) AS crossing_ratio FROM h GROUP BY GROUPING SETS ((horizon, tier, split), (horizon, tier), (horizon))
HAVING GROUPING_ID(tier, split) > 0 OR split IS NOT NULL""")
def composition_at_horizons(spark, sf_dir):
    return rounded(stats.composition_at(samples(spark, sf_dir)))


@query(f"""WITH {ASSEMBLED_SQL}, counted AS (SELECT reason, count(*) AS n FROM (SELECT reason FROM judged UNION ALL SELECT reason FROM proposed UNION ALL SELECT reason FROM samples) WHERE reason IS NOT NULL GROUP BY reason)
SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM counted""")
def skip_shares(spark, sf_dir):
    """Every reason for which a track or window gave no sample, with its share of all of them."""
    return rounded(stats.shares(assembly.skips(_assembled(spark, sf_dir))))


EGO_SQL = f"""{FRAMES_SQL},
poses AS (SELECT seq, t, min(x) AS x, min("y") AS py, min(x) / 20 AS turn FROM frames WHERE track % 50 = 0 GROUP BY seq, t),
keyframes AS (SELECT seq, (min(t) + max(t)) / 2 AS t FROM frames GROUP BY seq),
pb AS (SELECT k.*, p.t AS t0, p.x AS x0, p.py AS y0, p.turn AS a0 FROM keyframes k ASOF LEFT JOIN poses p ON k.seq = p.seq AND k.t >= p.t),
pa AS (SELECT pb.*, p.t AS t1, p.x AS x1, p.py AS y1, p.turn AS a1 FROM pb ASOF LEFT JOIN poses p ON pb.seq = p.seq AND pb.t < p.t),
near AS (SELECT seq, t, CASE WHEN t0 IS NULL OR t1 IS NULL THEN 0.0 ELSE (t - t0) / (t1 - t0) END AS share, coalesce(x0, x1) AS x0, coalesce(x1, x0) AS x1, coalesce(y0, y1) AS y0, coalesce(y1, y0) AS y1,
  coalesce(a0, a1) AS a0, coalesce(a1, a0) AS a1 FROM pa WHERE t0 IS NOT NULL OR t1 IS NOT NULL),
ego AS (SELECT seq, t, x, py, turn, false AS keyframe FROM poses
  UNION ALL SELECT seq, t, x0 + share * (x1 - x0), y0 + share * (y1 - y0), a0 + share * atan2(sin(a1 - a0), cos(a1 - a0)), true FROM near)"""


def _ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vehicle is where its sequence's first user is, and turns by a radian for every twenty of their value; keyframes are the middles of sequences."""
    rows = frames(spark, sf_dir)
    cos, sin, zero, one = F.cos("turn"), F.sin("turn"), F.lit(0.0), F.lit(1.0)
    seen = rows.where("track % 50 = 0").groupBy("seq", "t").agg(F.min("x").alias("x"), F.min("y").alias("y")).withColumn("turn", F.col("x") / 20)
    matrix = F.array(cos, -sin, zero, F.col("x"), sin, cos, zero, F.col("y"), zero, zero, one, zero, zero, zero, zero, one)
    own = F.col("seq").cast("string").alias("sequence_id")
    middle = rows.groupBy("seq").agg(((F.min("t") + F.max("t")) / 2).alias("t"))
    return poses.ego_path(seen.select(own, F.col("t").alias("ts"), matrix.alias("pose")), middle.select(own, "t"))


@query(f"""WITH {EGO_SQL} SELECT seq::VARCHAR AS sequence_id, round(t, 6) AS t, round(x, 4) AS x, round(py, 4) AS y, round(cos(turn), 4) AS heading_x, round(sin(turn), 4) AS heading_y, keyframe FROM ego""")
def ego_path(spark, sf_dir):
    return _ego(spark, sf_dir).withColumns({"t": F.round("t", 6), **{c: F.round(c, 4) for c in ("x", "y", "heading_x", "heading_y")}})


@query(f"""WITH {EGO_SQL}, placed AS (SELECT seq, track, bool_or(kind = 'signup') AS anchored,
  coalesce(arg_min(x, (t, frame)) FILTER (kind = 'signup'), arg_min(x, (t, frame))) AS x, coalesce(arg_min("y", (t, frame)) FILTER (kind = 'signup'), arg_min("y", (t, frame))) AS py FROM frames GROUP BY seq, track)
SELECT p.seq::VARCHAR AS sequence_id, track, anchored, round(sqrt(power(p.x - e.x, 2) + power(p.py - e.py, 2)), 4) AS "range" FROM placed p LEFT JOIN (SELECT * FROM ego WHERE keyframe) e USING (seq)""")
def keyframe_ranges(spark, sf_dir):
    """How far each track's anchor (signup), or its first frame, is from the vehicle at the keyframe."""
    rows = frames(spark, sf_dir).withColumn("sequence_id", F.col("seq").cast("string"))
    return poses.keyframe_ranges(rows, _ego(spark, sf_dir), F.col("kind") == "signup").withColumn("range", F.round("range", 4))


@query(f"""WITH {ACTIONS_SQL}, keyframes AS (SELECT seq, (min(t) + max(t)) / 2 AS moment FROM frames WHERE seq % 7 <> 3 GROUP BY seq),
named AS (SELECT *, left(track::VARCHAR, 8) AS name FROM actions WHERE starts_with(track::VARCHAR, '1'))
SELECT n.seq, track, CASE WHEN status <> 'determined' THEN name || ': UNDETERMINED (empty track)' WHEN NOT coalesce(crosses, false) THEN name || ': no road cross' WHEN moment IS NULL THEN name || ': CROSSES ROAD'
  ELSE printf('%s: CROSSES ROAD  t_c=%+.1fs', name, crossing_t - moment) END AS banner FROM named n LEFT JOIN keyframes USING (seq)""")
def action_banners(spark, sf_dir):
    """Lines on the tracks whose id begins with 1; some sequences have no keyframe."""
    rows = frames(spark, sf_dir)
    middle = rows.where("seq % 7 <> 3").groupBy("seq").agg(((F.min("t") + F.max("t")) / 2).alias("moment"))
    return actions.banners(_actions(rows), middle, "1")
