"""State of births as a stream: what it costs follows steps and tracks, not candidates."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_io import born_inputs
from trackloom.operators.tracking import Births
from trackloom.streaming import online


def test_candidates_are_held_by_step(spark, tmp_path):
    """Two hundred candidates of two steps are two values of the state, and all of them come back."""
    rows = [(1, step / 9, float(i), None if i % 10 == 0 else 0.0, 1.0) for step in range(2) for i in range(100)]
    stream = born_inputs(spark, tmp_path / "in", [rows])
    state = f"file://{tmp_path}/state"
    online.drained(online.born_stream(stream.withWatermark("closes", "1 hour")), "held", state)
    held = [bytes(r[0]) for r in spark.read.format("statestore").option("stateVarName", "held").load(state).select(F.col("list_element.rows")).collect()]
    assert len(held) == 2
    got = np.frombuffer(b"".join(held)).reshape(-1, 4)
    assert sorted(map(str, got.tolist())) == sorted(str([t, x, np.nan if y is None else y, z]) for _, t, x, y, z in rows)


def test_a_full_step_is_cut_and_tracks_come_back(monkeypatch):
    monkeypatch.setattr(online, "_HELD_ROWS", 3)
    held = online._held(np.array([9, 5, 9, 9, 9]), np.arange(20.0).reshape(5, 4))
    assert [(c, len(x) // 32) for c, x in held] == [(5, 1), (9, 3), (9, 1)]
    births = Births()
    for t, x in ((0.0, 0.0), (0.1, 0.1), (0.2, 50.0)):
        births.frame(t, np.array([[x, 0.0, 0.0]]))
    again = online._restored(online._state(births), births.opened, births.motion)
    for own in (births, again):
        own.frame(0.3, np.array([[0.2, 0.0, 0.0]]))
    assert [[(t, seen, list(p)) for t, seen, p in log] for log in again.logs] == [[(t, seen, list(p)) for t, seen, p in log] for log in births.logs]
    assert (again.states.at == births.states.at).all() and (again.states.p == births.states.p).all() and (again.missed == births.missed).all()
