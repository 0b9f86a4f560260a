"""Poses of the vehicle over time: interpolation between neighbours, and points in its frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .temporal import neighbours


def rotation_to_quaternion(m: np.ndarray) -> np.ndarray:
    """(n, 3, 3) to (n, 4), scalar first: the eigenvector of the symmetric form, stable for any turn."""
    k = np.zeros((len(m), 4, 4))
    d = np.einsum("nii->ni", m)
    k[:, 0, 0] = d.sum(1)
    for i in range(3):
        k[:, i + 1, i + 1] = 2 * d[:, i] - d.sum(1)
    for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        k[:, a + 1, b + 1] = k[:, b + 1, a + 1] = m[:, a, b] + m[:, b, a]
        k[:, 0, c + 1] = k[:, c + 1, 0] = m[:, b, a] - m[:, a, b]
    return np.linalg.eigh(k)[1][:, :, -1]


def quaternion_to_rotation(q: np.ndarray) -> np.ndarray:
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    rows = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    return np.array(rows).transpose(2, 0, 1)


def between(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Poses (n, 4, 4) at shares of the way from a to b: linear in place, along the shorter arc in turn."""
    share = np.clip(share, 0, 1)[:, None]
    p, q = rotation_to_quaternion(a[:, :3, :3]), rotation_to_quaternion(b[:, :3, :3])
    dot = (p * q).sum(1, keepdims=True)
    q, dot = np.where(dot < 0, -q, q), np.abs(dot)
    angle = np.arccos(np.clip(dot, -1, 1))
    sine = np.sin(angle)
    small = sine < 1e-9
    safe = np.where(small, 1, sine)
    turn = np.where(small, (1 - share) * p + share * q, (np.sin((1 - share) * angle) * p + np.sin(share * angle) * q) / safe)
    out = np.tile(np.eye(4), (len(a), 1, 1))
    out[:, :3, :3] = quaternion_to_rotation(turn)
    out[:, :3, 3] = (1 - share) * a[:, :3, 3] + share * b[:, :3, 3]
    return out


def poses_at(moments: DataFrame, poses: DataFrame) -> DataFrame:
    """The pose (16 values by rows) of each moment (sequence_id, t), constant before the first and after the last pose.

    One merged timeline finds both neighbours; only the arc itself runs in numpy, on whole batches.
    """
    left = moments.select("sequence_id", "t").withColumn("frame", F.lit(0))
    both = neighbours(left, poses.withColumn("t", F.col("ts")), F.col("pose"), "sequence_id")
    near = both.select("sequence_id", "t", F.coalesce("b", "a").alias("lo"), F.coalesce("a", "b").alias("hi")).where("lo is not null")
    flat = near.select("sequence_id", "t", F.col("lo.t").alias("t0"), F.col("hi.t").alias("t1"), F.col("lo.v").alias("p0"), F.col("hi.v").alias("p1"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                p0, p1 = (np.stack(rows[c].to_numpy()).reshape(-1, 4, 4) for c in ("p0", "p1"))
                gap = (rows["t1"] - rows["t0"]).to_numpy()
                share = np.where(gap > 0, (rows["t"] - rows["t0"]).to_numpy() / np.where(gap > 0, gap, 1), 0)
                yield pd.DataFrame({"sequence_id": rows["sequence_id"], "t": rows["t"], "pose": list(between(p0, p1, share).reshape(-1, 16))})

    return flat.mapInPandas(run, "sequence_id string, t double, pose array<double>")


def ego_path(poses: DataFrame, keyframes: DataFrame) -> DataFrame:
    """sequence_id, t, x, y, heading_x, heading_y, keyframe: every pose of the vehicle seen from above, and (`keyframe`) the one that it has at
    the sequence's keyframe (sequence_id, t), between its neighbours. A sequence without poses has no rows; one without a keyframe has its path alone."""

    def flat(rows: DataFrame, t: str, keyframe: bool) -> DataFrame:
        at = lambda i: F.col("pose")[i]
        return rows.select("sequence_id", F.col(t).alias("t"), at(3).alias("x"), at(7).alias("y"), at(0).alias("heading_x"), at(4).alias("heading_y"), F.lit(keyframe).alias("keyframe"))

    return flat(poses, "ts", False).unionByName(flat(poses_at(keyframes, poses), "t", True))


def keyframe_ranges(frames: DataFrame, path: DataFrame, anchor: Column) -> DataFrame:
    """sequence_id, track, anchored, range: how far each track is from the vehicle at the keyframe.

    A track stands where its first anchor is, one without an anchor at its first frame; the range is null where the sequence has no pose at its
    keyframe. frames: sequence_id, track, frame, t, x, y; `path` as `ego_path` gives it.
    """
    place, order = F.struct("x", "y"), F.struct("t", "frame")
    own = frames.groupBy("sequence_id", "track").agg(F.min_by(place, F.when(anchor, order)).alias("anchor"), F.min_by(place, order).alias("first"))
    here = path.where("keyframe").select("sequence_id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    at = F.coalesce("anchor", "first")
    gap = F.sqrt((at["x"] - F.col("_x")) ** 2 + (at["y"] - F.col("_y")) ** 2)
    return own.join(here, "sequence_id", "left").select("sequence_id", "track", F.col("anchor").isNotNull().alias("anchored"), gap.alias("range"))
