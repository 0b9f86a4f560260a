"""Comparison of a query with its SQL oracle on DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x) else (f"{x:.9g}" if isinstance(x, float) else str(x)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_equal(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    a, b = normal(got), normal(want)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(), b[(a != b).any(axis=1)].head())
