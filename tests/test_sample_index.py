"""Frames a moment after a window's end are within its slack."""

import duckdb

from trackloom import catalog
from trackloom.assembled import ASSEMBLED_SQL

from .oracle import assert_equal


def test_index_rows_read_frames_within_the_slack(spark, sf, tmp_path):
    """Four seconds after the end of every window its track has one more frame, and another without a value."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    con.execute(f"""copy (SELECT * FROM events UNION ALL BY NAME SELECT 1000000 + row_number() OVER () AS event_id, make_timestamp(round(("end" + 0.00005) * 86400000000)::BIGINT + i) AS ts, user_id, 'view' AS event_type, if(i = 0, 7.25, NULL) AS value, '{{"k": 5}}' AS props
      FROM (WITH {ASSEMBLED_SQL} SELECT track AS user_id, "end" FROM samples WHERE reason IS NULL), range(2) r(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create or replace view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(catalog.ORACLES["sample_index_rows"]).df()
    assert len(want) and con.execute(f"WITH {ASSEMBLED_SQL} SELECT count(*) FROM samples s JOIN frames f USING (track) WHERE reason IS NULL AND f.t > s.\"end\" AND f.t <= s.\"end\" + 0.0001").fetchone()[0]
    assert_equal(catalog.QUERIES["sample_index_rows"](spark, str(tmp_path)).toPandas(), want)
