"""Motion filtering and tracking of point candidates, in Arrow-fed functions over whole arrays of tracks.

The state of a track is position and velocity on each axis; the axes share one covariance (three numbers). Steps depend on
each other in time, so only time is a loop: a step predicts, matches and updates all tracks of a group at once,
and the smoother goes through many tracks side by side. A group is a clip (`by`), which bounds it in space and time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .temporal import asof_nearest


@dataclass(frozen=True)
class Motion:
    nominal_dt: float = 0.111
    noise_position: float = 0.05
    noise_velocity: float = 0.3
    first_position: float = 0.5
    first_velocity: float = 2.0
    measurement: float = 0.3
    gate: float = 9.0
    clip: float = 25.0
    misses: int = 5
    support: int = 4
    lasting: float = 1.0


AXES = ["x", "y", "z"]
#: Rows of whole tracks that the smoother takes at once.
ROWS = 100_000


class States:
    """Positions and velocities (n, axes) and shared covariances p (n, 3): of position, of both, of velocity."""

    def __init__(self, at: np.ndarray, m: Motion):
        self.m, self.at, self.speed = m, at.astype(float), np.zeros(at.shape)
        self.p = np.tile([m.first_position**2, 0.0, m.first_velocity**2], (len(at), 1))

    def predict(self, dt: np.ndarray) -> np.ndarray:
        """Moves all states on by dt; where time does not move on, the nominal step is taken. Returns the steps taken."""
        m, dt = self.m, np.where(dt > 0, dt, self.m.nominal_dt)
        a, b, c = self.p.T
        q = m.noise_velocity**2
        self.at = self.at + dt[:, None] * self.speed
        self.p = np.stack([a + 2 * dt * b + dt * dt * c + q * dt**4 / 4 + m.noise_position**2, b + dt * c + q * dt**3 / 2, c + q * dt * dt], axis=1)
        return dt

    def update(self, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Corrects the states `rows` by what was measured; returns their squared distances from the prediction."""
        p, off = self.p[rows], found - self.at[rows]
        s = p[:, 0] + self.m.measurement**2
        self.at[rows] += (p[:, 0] / s)[:, None] * off
        self.speed[rows] += (p[:, 1] / s)[:, None] * off
        self.p[rows] = p - np.stack([p[:, 0] ** 2, p[:, 0] * p[:, 1], p[:, 1] ** 2], axis=1) / s[:, None]
        return (off * off).sum(axis=1) / s

    def distances(self, found: np.ndarray) -> np.ndarray:
        """Squared distances (states, candidates)."""
        off = found[None] - self.at[:, None]
        return (off * off).sum(axis=2) / (self.p[:, 0] + self.m.measurement**2)[:, None]

    def kept(self, rows: np.ndarray) -> None:
        self.at, self.speed, self.p = self.at[rows], self.speed[rows], self.p[rows]

    def joined(self, at: np.ndarray) -> None:
        new = States(at, self.m)
        self.at, self.speed, self.p = (np.concatenate([a, b]) for a, b in ((self.at, new.at), (self.speed, new.speed), (self.p, new.p)))


def smooth_all(sizes: np.ndarray, t: np.ndarray, z: np.ndarray, seen: np.ndarray, m: Motion = Motion()) -> tuple[np.ndarray, np.ndarray]:
    """Forward filter and backward smoother of many tracks, which stand one after the other in rows (`sizes` long each).

    z: (rows, axes). Returns smoothed positions and confidences. The first step predicts once over the nominal interval; a frame without
    measurement has confidence 0. A step of the loop takes the i-th frame of all tracks that are so long.
    """
    n, axes = z.shape
    order = np.argsort(-sizes, kind="stable")
    start, longest = (np.cumsum(sizes) - sizes)[order], sizes[order]
    marks = np.flatnonzero(seen)
    first = np.searchsorted(marks, start)  # of each track's measurements; none: its first row
    has = (first < len(marks)) & (marks[np.minimum(first, len(marks) - 1)] < start + longest) if len(marks) else np.zeros(len(start), dtype=bool)
    seed = np.where(has, marks[np.minimum(first, max(0, len(marks) - 1))] if len(marks) else start, start)
    state = States(z[seed], m)
    confidence, place, speed = np.zeros(n), np.empty((n, axes)), np.empty((n, axes))
    cov, prior_place, prior_speed, prior_cov, steps = np.empty((n, 3)), np.empty((n, axes)), np.empty((n, axes)), np.empty((n, 3)), np.empty(n)
    alive = np.searchsorted(-longest, -np.arange(longest[0] if len(longest) else 0), side="left")  # tracks longer than i
    for i, k in enumerate(alive.tolist()):
        if k < len(state.at):
            state.kept(np.arange(k))
        row = start[:k] + i
        steps[row] = state.predict(np.full(k, m.nominal_dt) if i == 0 else t[row] - t[row - 1])
        prior_place[row], prior_speed[row], prior_cov[row] = state.at, state.speed, state.p
        hit = np.flatnonzero(seen[row])
        if len(hit):
            confidence[row[hit]] = np.exp(-0.5 * np.minimum(state.update(hit, z[row[hit]]), m.clip))
        place[row], speed[row], cov[row] = state.at, state.speed, state.p
    for i in range(len(alive) - 2, -1, -1):  # the last frame of a track is as filtered
        row = start[: alive[i + 1]] + i
        (a, b, c), (p, q, r), dt = cov[row].T, prior_cov[row + 1].T, steps[row + 1]
        det = p * r - q * q
        left, right = (a + b * dt, b), (b + c * dt, c)  # covariance times transposed transition
        gain = [((u * r - v * q) / det, (v * p - u * q) / det) for u, v in (left, right)]
        off, off_speed = place[row + 1] - prior_place[row + 1], speed[row + 1] - prior_speed[row + 1]
        place[row] += gain[0][0][:, None] * off + gain[0][1][:, None] * off_speed
        speed[row] += gain[1][0][:, None] * off + gain[1][1][:, None] * off_speed
    return place, confidence


def smooth(t: np.ndarray, z: np.ndarray, seen: np.ndarray, m: Motion = Motion()) -> tuple[np.ndarray, np.ndarray]:
    """`smooth_all` for one track."""
    return smooth_all(np.array([len(t)]), t, z, seen, m)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = ROWS) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups, of about so many rows (a longer group stands alone)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.flatnonzero(table.column(key).to_numpy() != table.column(key)[-1].as_py())
            if len(last):  # the group that the last row belongs to may go on
                yield table.slice(0, last[-1] + 1)
                table = table.slice(last[-1] + 1).combine_chunks()
            held, size = table.to_batches(), 0  # a group is joined only when a further `rows` rows have come
    if held:
        yield pa.Table.from_batches(held)


def smooth_tracks(frames: DataFrame, motion: Motion = Motion(), axes: Sequence[str] = AXES) -> DataFrame:
    """track, frame, t, smoothed places on the axes, confidence of frames (track, frame, t, observed, axes).

    One exchange on the track; a task smooths as many whole tracks at once as make `ROWS` rows.
    """
    names = ["track", "frame", "t", *axes, "confidence"]

    def run(batches: Iterator[pa.RecordBatch]):
        for table in whole_groups(batches, "track"):
            track = table.column("track").to_numpy()
            edges = np.flatnonzero(np.diff(track, prepend=track[0] - 1))
            z = np.stack([table.column(c).to_numpy() for c in axes], axis=1)
            place, confidence = smooth_all(np.diff(edges, append=len(track)), table.column("t").to_numpy(), z, table.column("observed").to_numpy(), motion)
            yield from pa.table([table.column("track"), table.column("frame"), table.column("t"), *place.T, confidence], names=names).to_batches()

    own = frames.select(F.col("track").cast("long").alias("track"), F.col("frame").cast("long").alias("frame"), "t", F.coalesce("observed", F.lit(False)).alias("observed"), *axes)
    return own.repartition("track").sortWithinPartitions("track", "t", "frame").mapInArrow(run, ", ".join(["track long", "frame long", "t double", *[f"{c} double" for c in axes], "confidence double"]))


class Births:
    """Tracks of one clip, frame by frame: predict all, match cheapest first, open tracks for what is left, retire."""

    def __init__(self, motion: Motion = Motion(), axes: int = 3):
        self.motion, self.opened = motion, 0
        self.states = States(np.zeros((0, axes)), motion)
        self.t, self.missed = np.zeros(0), np.zeros(0, dtype=np.int64)
        self.logs: list[list[tuple[float, bool, np.ndarray]]] = []  # (time, seen, place) of the active tracks

    def frame(self, t: float, found: np.ndarray) -> list[list]:
        """Takes the candidates (n, axes) of one time; returns the logs of the tracks that retired confirmed."""
        n, m = len(self.logs), self.motion
        self.states.predict(np.abs(t - self.t))
        self.t = np.full(n, t)
        distance = self.states.distances(found)
        track, own = np.nonzero(distance <= m.gate)
        match, used = np.full(n, -1), np.zeros(len(found), dtype=bool)
        for k in np.lexsort((own, track, distance[track, own])).tolist():
            i, j = track[k], own[k]
            if match[i] < 0 and not used[j]:
                match[i], used[j] = j, True
        hit = np.flatnonzero(match >= 0)
        if len(hit):
            self.states.update(hit, found[match[hit]])
        self.missed = np.where(match >= 0, 0, self.missed + 1)
        for i, j in enumerate(match.tolist()):
            self.logs[i].append((t, j >= 0, found[j] if j >= 0 else self.states.at[i].copy()))
        stay = np.flatnonzero(self.missed < m.misses)
        gone = [self.logs[i] for i in np.flatnonzero(self.missed >= m.misses)]
        self.keep(stay)
        self.open(t, found[~used])
        return [log for log in gone if self.confirmed(log)]

    def keep(self, rows: np.ndarray) -> None:
        self.states.kept(rows)
        self.t, self.missed, self.logs = self.t[rows], self.missed[rows], [self.logs[i] for i in rows]

    def open(self, t: float, at: np.ndarray) -> None:
        self.states.joined(at)
        self.t, self.missed = np.append(self.t, np.full(len(at), t)), np.append(self.missed, np.zeros(len(at), dtype=np.int64))
        self.logs += [[(t, True, place)] for place in at]
        self.opened += len(at)

    def confirmed(self, log: list) -> bool:
        times = [t for t, seen, _ in log if seen]
        return len(times) >= self.motion.support and times[-1] - times[0] >= self.motion.lasting

    def rest(self) -> list[list]:
        return [log for log in self.logs if self.confirmed(log)]


def trimmed(log: list) -> list:
    """The log without the misses at its end."""
    return log[: 1 + max(i for i, entry in enumerate(log) if entry[1])]


def finished_tracks(logs: list[list], first: int, motion: Motion) -> dict[str, np.ndarray]:
    """Columns track (numbers from `first`), t, observed, x, y, z, confidence of smoothed tracks."""
    logs = [trimmed(log) for log in logs]
    sizes = np.array([len(log) for log in logs], dtype=np.int64)
    t, seen = np.array([e[0] for log in logs for e in log], dtype=float), np.array([e[1] for log in logs for e in log], dtype=bool)
    place, confidence = smooth_all(sizes, t, np.array([e[2] for log in logs for e in log], dtype=float).reshape(-1, len(AXES)), seen, motion)
    return {"track": np.repeat(np.arange(first, first + len(logs)), sizes), "t": t, "observed": seen, **dict(zip(AXES, place.T, strict=True)), "confidence": confidence}


def candidates_by_time(t: np.ndarray, at: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
    """Times in order, each with its candidates in order of place; a row without a place only says that there was a frame."""
    order = np.lexsort((*at.T[::-1], t))
    t, at = t[order], at[order]
    for own in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t)) + 1):
        if len(own):
            yield float(t[own[0]]), at[own][~np.isnan(at[own, 0])]


BORN = "track long, t double, observed boolean, x double, y double, z double, confidence double"


def born_tracks(candidates: DataFrame, motion: Motion = Motion(), by: Sequence[str] = ("seq",)) -> DataFrame:
    """Tracks born from candidates (`by`, t, x, y, z; a row without x is a frame without candidates), numbered in each clip as they retire."""
    return candidates.select(*by, "t", *AXES).groupBy(*by).applyInArrow(born_in(by, motion), _clip_schema(candidates, by))


def born_in(by: Sequence[str], motion: Motion = Motion()) -> Callable[[pa.Table], pa.Table]:
    """The grouped function of `born_tracks`, for use with `guarded`."""

    def run(own: pa.Table) -> pa.Table:
        births, done = Births(motion), []
        for t, found in candidates_by_time(own.column("t").to_numpy(), np.stack([own.column(c).to_pandas().to_numpy(dtype=float) for c in AXES], axis=1)):
            done += births.frame(t, found)
        columns = finished_tracks(done + births.rest(), 0, motion)
        keys = {c: pa.array([own.column(c)[0].as_py()] * len(columns["t"]), own.column(c).type) for c in by}
        return pa.table(keys | {c: pa.array(v) for c, v in columns.items()})

    return run


def _clip_schema(rows: DataFrame, by: Sequence[str]) -> str:
    return ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in by], BORN])


# ---- tracks from anchors --------------------------------------------------------------------------

def directed_passes(times: np.ndarray, candidates: list[np.ndarray], points: list[np.ndarray], starts: np.ndarray, seeds: np.ndarray, motion: Motion = Motion()) -> dict[str, np.ndarray]:
    """Passes from many seeds at once, each from the frame after its start: at every frame the nearest candidate inside the gate or a
    miss; a pass ends after the last allowed miss. Passes do not compete for candidates.

    Returns one row for each pass and frame: anchor (number), frame (number), seen, place, points (-1 for a miss).
    """
    own, missed, state = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), States(np.zeros((0, seeds.shape[1])), motion)
    fresh, out = np.zeros(0, dtype=bool), []
    by_start = np.argsort(starts, kind="stable")
    bounds = np.searchsorted(starts[by_start], np.arange(-1, len(times)))
    for i, found in enumerate(candidates):
        new = by_start[bounds[i] : bounds[i + 1]]  # those that start at the frame before
        if len(new):
            state.joined(seeds[new])
            own, missed, fresh = np.append(own, new), np.append(missed, np.zeros(len(new), dtype=np.int64)), np.append(fresh, np.ones(len(new), dtype=bool))
        if not len(own):
            continue
        state.predict(np.where(fresh, motion.nominal_dt, abs(times[i] - times[i - 1])))
        fresh[:] = False
        at, n = np.full(state.at.shape, np.nan), np.full(len(own), -1)
        hit = np.zeros(len(own), dtype=bool)
        if len(found):
            distance = state.distances(found)
            near = distance.argmin(axis=1)
            hit = distance[np.arange(len(own)), near] <= motion.gate
            at[hit], n[hit] = found[near[hit]], points[i][near[hit]]
            state.update(np.flatnonzero(hit), at[hit])
        missed = np.where(hit, 0, missed + 1)
        out.append((own, np.full(len(own), i), hit, at, n))
        stay = np.flatnonzero(missed < motion.misses)
        if len(stay) < len(own):
            state.kept(stay)
            own, missed, fresh = own[stay], missed[stay], fresh[stay]
    empty = (own[:0], own[:0], np.zeros(0, dtype=bool), np.zeros((0, seeds.shape[1])), own[:0])
    return dict(zip(("anchor", "frame", "seen", "place", "points"), (np.concatenate(c) for c in zip(empty, *out, strict=True)), strict=True))


def anchor_frame(times: np.ndarray, t: float) -> int:
    """The frame nearest to a moment, the earlier of equals."""
    return int(np.argmin(np.abs(times - t)))


ANCHORED = "t double, observed boolean, x double, y double, z double, points int, method string, confidence double"


def anchored_tracks(pool: DataFrame, anchors: DataFrame, motion: Motion = Motion(), seq: str = "seq") -> DataFrame:
    """One track for each anchor (seq, key, t, x, y, z), from the frame of the pool nearest to it forward and backward.

    pool: candidates (seq, t, x, y, z, points), a row without x is a frame without candidates. A clip's pool meets its
    anchors in one cogroup; each anchor takes candidates of its own (they may share them). The anchor stands in its frame's
    place as observed, without points; all tracks of a clip are smoothed at once. Anchors of clips without frames give no rows.
    """

    def run(frames: pa.Table, seeds: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in ANCHORED.split(", ")]
        rows = frames.select(["t", *AXES, "points"]).to_pandas().sort_values(["t", *AXES, "points"])
        groups = [(t, own.dropna(subset=["x"])) for t, own in rows.groupby("t")]
        times = np.array([t for t, _ in groups])
        places, counts = [g[AXES].to_numpy() for _, g in groups], [g["points"].fillna(-1).to_numpy() for _, g in groups]
        own = seeds.sort_by("key")
        place = np.stack([own.column(c).to_numpy() for c in AXES], axis=1)
        start = np.array([anchor_frame(times, t) for t in own.column("t").to_pylist()] if groups else [], dtype=np.int64)
        n, last = len(start), len(times) - 1
        ahead = directed_passes(times, places, counts, start, place, motion)
        behind = directed_passes(times[::-1], places[::-1], counts[::-1], last - start, place, motion)
        behind["frame"] = last - behind["frame"]
        here = {"anchor": np.arange(n), "frame": start, "seen": np.ones(n, dtype=bool), "place": place[:n], "points": np.full(n, -1)}
        steps = {c: np.concatenate([behind[c], here[c], ahead[c]]) for c in here}
        method = np.repeat(["backward", "anchor", "forward"], [len(behind["frame"]), n, len(ahead["frame"])])
        order = np.lexsort((steps["frame"], steps["anchor"]))
        anchor, frame, seen, z, n_points = (steps[c][order] for c in here)
        t = times[frame]
        smoothed, confidence = smooth_all(np.bincount(anchor, minlength=n), t, z, seen, motion)
        of = pa.array([own.column(seq)[0].as_py() if own.num_rows else None] * len(t), own.column(seq).type)
        return pa.table([of, own.column("key").take(pa.array(anchor)), t, seen, *smoothed.T, n_points.astype(np.int32), pa.array(method[order].tolist(), pa.string()), confidence], names=[seq, "key", *names])

    schema = f"{seq} {anchors.schema[seq].dataType.simpleString()}, key {anchors.schema['key'].dataType.simpleString()}, {ANCHORED}"
    left = pool.select(seq, F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in AXES], F.col("points").cast("double").alias("points"))
    right = anchors.select(seq, "key", F.col("t").cast("double").alias("t"), *[F.col(c).cast("double").alias(c) for c in AXES])
    return left.groupBy(seq).cogroup(right.groupBy(seq)).applyInArrow(run, schema)


def anchor_frames(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """seq, key and the time of the pool's frame nearest to each anchor, the earlier of equals, by joining both in time."""
    at = anchors.select(F.col("seq").alias("track"), F.col("key").alias("frame"), "t")
    found = asof_nearest(at, pool.select(F.col("seq").alias("track"), "t").distinct(), F.col("t"))
    return found.select(F.col("track").alias("seq"), F.col("frame").alias("key"), F.col("match_t").alias("frame_t"), "gap")
