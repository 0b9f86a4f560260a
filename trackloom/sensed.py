"""Registered queries of scans, candidate pools, claims, boxes from motion and the scorer; see `catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import KALMAN_SQL, MOTION, query, rounded
from .operators import boxes, pool, scorer, scoring, tracking
from .plans.adapters import FRAMES_SQL, POINTS_SQL, frames, points
from .session import scratch, written
from .sources import npy

# ---- scans as files -----------------------------------------------------------------------------

SCAN_US = 1_700_000_000_000_000


@query(f"""WITH {POINTS_SQL} SELECT {SCAN_US} + label * 100000 AS t_us, count(*) AS n, round(sum(x), 4) AS x, round(max(z), 4) AS z FROM points WHERE label BETWEEN 2 AND 7 GROUP BY label""")
def npy_scans(spark, sf_dir):
    """Points written as one structured file a scan and read back; the time filter goes to the reader."""
    rows = points(spark, sf_dir).where("label is not null").select(F.col("label").alias("scan"), (F.lit(SCAN_US) + F.col("label") * F.lit(100_000)).alias("t_us"), "x", "y", "z")
    folder = scratch(spark, "scans")
    written(npy.write_scans(rows, folder), "scan-files")
    npy.register(spark)
    scans = spark.read.format("npy").load(folder).where(F.col("t_us").between(SCAN_US + 200_000, SCAN_US + 700_000))
    return rounded(scans.groupBy("t_us").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.max("z").alias("z")), 4)


# ---- candidate pool -----------------------------------------------------------------------------

_PIXEL = ("900.0 * x / (abs(z) + 5) + 960.0", "910.0 * y / (abs(z) + 5) + 540.0")
POOL_SQL = f"""{POINTS_SQL}, p AS (SELECT label AS scan, vec_id, x, y, z, {_PIXEL[0]} AS u, {_PIXEL[1]} AS v FROM points),
scans AS (SELECT DISTINCT scan, scan * 0.1::DOUBLE + 0.03 AS t FROM p), images AS (SELECT DISTINCT scan // 2 AS image, (scan // 2) * 0.2::DOUBLE + 0.05 AS t FROM p WHERE scan < 8),
pairs AS (SELECT s.scan, s.t, i.image FROM scans s JOIN images i ON abs(i.t - s.t) <= 0.085 QUALIFY row_number() OVER (PARTITION BY s.scan ORDER BY abs(i.t - s.t), i.t) = 1),
b AS (SELECT q.scan, q.t, p.vec_id AS box, u - 250 AS x1, v - 250 AS y1, u + 250 AS x2, v + 250 AS y2 FROM pairs q JOIN p ON p.scan = 2 * q.image AND p.vec_id % 100 >= 20 AND p.x > -4.5),
i AS (SELECT b.scan, b.box, p.x, p.y, p.z, sqrt(p.x * p.x + p.y * p.y) AS r FROM b JOIN p ON p.scan = b.scan AND p.u BETWEEN x1 + 0.2 * (x2 - x1) AND x2 - 0.2 * (x2 - x1) AND p.v BETWEEN y1 + 0.1 * (y2 - y1) AND y1 + 0.9 * (y2 - y1)),
n AS (SELECT scan, box, quantile_cont(r, 0.15) AS near, count(*) AS n_all FROM i GROUP BY scan, box),
m AS (SELECT i.*, r <= near + 1.5 AS s, n_all FROM i JOIN n USING (scan, box)),
l AS (SELECT scan, box, count(*) FILTER (s) AS k, any_value(n_all) AS n_all, median(x) FILTER (s) AS sx, median(y) FILTER (s) AS sy, median(z) FILTER (s) AS sz, median(x) AS ax, median(y) AS ay, median(z) AS az FROM m GROUP BY scan, box),
lifted AS (SELECT scan, box, CASE WHEN k >= 3 THEN sx ELSE ax END AS x, CASE WHEN k >= 3 THEN sy ELSE ay END AS y, CASE WHEN k >= 3 THEN sz ELSE az END AS z, CASE WHEN k >= 3 THEN k ELSE n_all END AS n_points FROM l WHERE n_all >= 3)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten scans; two share an image, and the last two have none. Every second image is in the cache, the detector finds the boxes of the others."""
    p = written(points(spark, sf_dir).select(F.lit(0).alias("seq"), F.col("label").alias("scan"), "vec_id", "x", "y", "z", F.expr(_PIXEL[0]).alias("u"), F.expr(_PIXEL[1]).alias("v")), "pixels")
    scans = p.select("seq", "scan", (F.col("scan") * F.lit(0.1) + 0.03).alias("t")).distinct()
    images = p.where("scan < 8").select("seq", F.floor(F.col("scan") / 2).alias("image"), (F.floor(F.col("scan") / 2) * F.lit(0.2) + 0.05).alias("t")).distinct()
    own = p.where("scan % 2 = 0 and x > -4.5").select("seq", F.floor(F.col("scan") / 2).alias("image"), F.col("vec_id").alias("box"), *[(F.col(c) + d).alias(n) for n, c, d in (("x1", "u", -250), ("y1", "v", -250), ("x2", "u", 250), ("y2", "v", 250))], (F.col("vec_id") % 100 / 100).alias("score"))
    paired = written(pool.pairs(scans, images, 0.085), "pairs")
    boxes = pool.detected(paired, images.where("image % 2 = 0"), own.where("image % 2 = 0"), lambda missing: own.join(missing, ["seq", "image"]), least=0.2)
    return pool.candidates(paired, boxes, p.select("scan", "x", "y", "z", "u", "v"))


@query(f"WITH {POOL_SQL} SELECT p.scan, round(p.t, 6) AS t, box, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, n_points FROM pairs p LEFT JOIN lifted USING (scan)")
def candidate_pool(spark, sf_dir):
    return rounded(_pool(spark, sf_dir).drop("seq"))


@query(f"WITH {POOL_SQL} SELECT DISTINCT image FROM pairs WHERE image % 2 = 1")
def detection_misses(spark, sf_dir):
    """Images that scans need and the cache has not."""
    rows = points(spark, sf_dir).select(F.lit(0).alias("seq"), F.col("label").alias("scan"))
    scans = rows.select("seq", "scan", (F.col("scan") * F.lit(0.1) + 0.03).alias("t")).distinct()
    images = rows.where("scan < 8").select("seq", F.floor(F.col("scan") / 2).alias("image"), (F.floor(F.col("scan") / 2) * F.lit(0.2) + 0.05).alias("t")).distinct()
    return pool.misses(pool.pairs(scans, images, 0.085), images.where("image % 2 = 0")).select("image")


# ---- claims -------------------------------------------------------------------------------------

STEP_US = 21_600_000_000


@query(f"""WITH RECURSIVE {KALMAN_SQL}, claims AS (SELECT f.seq, f.t_us // {STEP_US} AS step, b.x AS ox, b.y AS oy FROM back b JOIN f USING (track, frame) WHERE track % 3 = 0),
own AS (SELECT seq, t_us // {STEP_US} AS step, frame, x, "y" FROM frames WHERE observed AND track % 3 <> 0),
free AS (SELECT * FROM own o WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.seq = o.seq AND c.step = o.step AND sqrt(power(c.ox - o.x, 2) + power(c.oy - o."y", 2)) <= 25))
SELECT seq, step * {STEP_US} AS t_us, frame AS key FROM free UNION ALL SELECT DISTINCT seq, step * {STEP_US}, NULL FROM own WHERE (seq, step) NOT IN (SELECT seq, step FROM free)""")
def residual_pool(spark, sf_dir):
    """Every third track is anchored; where it is at a step, observed or coasted, other candidates of its sequence are claimed."""
    rows = frames(spark, sf_dir)
    at = (F.floor(F.col("t_us") / STEP_US) * STEP_US).alias("t_us")
    anchored = tracking.smooth_tracks(rows.where("track % 3 = 0"), MOTION).select("frame", "x", "y")
    held = pool.claims(rows.select("seq", "frame", at).join(anchored, "frame"))
    own = rows.where("observed and track % 3 <> 0").select("seq", at, F.col("frame").alias("key"), "x", "y")
    return pool.residual(own, held, 25.0).select("seq", "t_us", "key")


# ---- boxes from motion --------------------------------------------------------------------------

_SLOPE = """CASE WHEN bt IS NULL AND nt IS NULL THEN 0.0 WHEN bt IS NULL THEN (n{c} - {c}) / (nt - t) WHEN nt IS NULL THEN ({c} - b{c}) / (t - bt)
  ELSE ((t - bt) * (t - bt) * n{c} + ((nt - t) * (nt - t) - (t - bt) * (t - bt)) * {c} - (nt - t) * (nt - t) * b{c}) / ((t - bt) * (nt - t) * (nt - bt)) END"""


@query(f"""WITH {FRAMES_SQL}, w AS (SELECT track, frame, t, x, "y" AS y1, z, lag(t) OVER o AS bt, lead(t) OVER o AS nt, lag(x) OVER o AS bx, lead(x) OVER o AS nx, lag("y") OVER o AS by1, lead("y") OVER o AS ny1, row_number() OVER o AS n FROM frames WINDOW o AS (PARTITION BY track ORDER BY t, frame)),
v AS (SELECT *, {_SLOPE.format(c="x")} AS vx, {_SLOPE.format(c="y1")} AS vy FROM w), m AS (SELECT *, sqrt(vx * vx + vy * vy) >= 600 AS moves, atan2(vy, vx) AS heading FROM v),
k AS (SELECT *, max(CASE WHEN moves THEN n END) OVER (PARTITION BY track ORDER BY n) AS before, min(CASE WHEN moves THEN n END) OVER (PARTITION BY track ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM m),
c AS (SELECT *, CASE WHEN ahead IS NULL OR n - before <= ahead - n THEN before ELSE ahead END AS source FROM k)
SELECT c.track, c.frame, round(c.t, 6) AS t, round(c.x, 6) AS x, round(c.y1, 6) AS y, round(c.z, 6) AS z, round(coalesce(s.heading, 0.0), 6) AS yaw, CASE WHEN c.moves THEN 'velocity' WHEN s.track IS NULL THEN 'undefined' ELSE 'static_fill' END AS yaw_source,
  0.5 + c.track % 5 / 10.0::DOUBLE AS length, 0.5::DOUBLE AS width, 1.7::DOUBLE AS height FROM c LEFT JOIN m s ON s.track = c.track AND s.n = c.source""")
def track_boxes(spark, sf_dir):
    rows = frames(spark, sf_dir)
    sizes = rows.select("track").distinct().select("track", (F.lit(0.5) + F.col("track") % 5 / 10.0).alias("length"), F.lit(0.5).alias("width"), F.lit(1.7).alias("height"))
    return rounded(boxes.from_motion(rows, sizes, slowest=600.0))


# ---- scorer -------------------------------------------------------------------------------------


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three days of a track are a window of boxes; it is positive where the track is on the road (beyond 150) within the three days after it."""
    rows = frames(spark, sf_dir).withColumn("window", F.floor(F.col("t") / 3))
    own = rows.groupBy("track", "window").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "frame", "x", "y"))), lambda b: F.struct((b["x"] - 5).alias("x1"), b["y"].alias("y1"), (b["x"] + 5).alias("x2"), (b["y"] + 20).alias("y2"))).alias("boxes"), F.max("x").alias("top"))
    after = own.select("track", (F.col("window") - 1).alias("window"), (F.col("top") > 150).cast("int").alias("label"))
    split = F.when(F.col("track") % 10 < 7, "train").when(F.col("track") % 10 == 7, "val").otherwise("test")
    return own.join(after, ["track", "window"]).select("track", split.alias("split"), "label", scoring.box_features(F.col("boxes"), 4, 500.0, 120.0).alias("features"))


@query()
def scorer_runs(spark, sf_dir):
    return rounded(scorer.runs(_windows(spark, sf_dir)))


@query()
def scorer_over_seeds(spark, sf_dir):
    """Mean and deviation of the test split's AUC and average precision over the seeds."""
    runs = scorer.runs(_windows(spark, sf_dir))
    long = runs.select(F.explode(F.create_map(F.lit("roc_auc"), "roc_auc", F.lit("average_precision"), "average_precision")).alias("metric", "value"))
    return rounded(scoring.over_seeds(long, ["metric"], "value"))
