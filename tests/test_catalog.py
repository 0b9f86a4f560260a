import pytest

import __spark_entry__ as entry
from trackloom import catalog

from .oracle import assert_equal, duck


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert_equal(catalog.QUERIES[name](spark, sf).toPandas(), duck(sf).execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_births_as_a_stream_are_those_of_the_batch(spark):
    """Equal rows, and nine of ten leave the stream itself."""
    sf = "/root/testdata/sf0.01"
    stream = catalog.QUERIES["streaming_births"](spark, sf).toPandas()
    batch = catalog.QUERIES["birth_tracks"](spark, sf).toPandas()
    assert_equal(stream.drop(columns=["streamed", "late"]), batch)
    assert not stream["late"].any() and stream["streamed"].mean() >= 0.9


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
