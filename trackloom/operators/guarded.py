"""Grouped functions that go on when one group fails: results and failures of one run.

A group whose function raises gives one row with the error beside its keys; all other groups' rows stay. Both come from
one written table, so a function runs once for each group whatever is read of it later. Errors outside the function (lost executors,
rows that do not fit the schema) still stop the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written

#: Longest text of an error that is kept.
LIMIT = 200


@dataclass
class Outcome:
    """`results`: the rows of the groups that went well; `failures`: keys and error of the others."""

    results: DataFrame
    failures: DataFrame


def apply(rows: DataFrame, by: Sequence[str], function: Callable[[pa.Table], pa.Table], schema: str) -> Outcome:
    """`function` on each group of `rows`; `schema` is that of its rows and holds the columns `by` under their names."""
    own = T._parse_datatype_string(schema)
    full = T.StructType([*own.fields, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(full)

    def run(group: pa.Table) -> pa.Table:
        try:
            got = function(group)
            return pa.table([*[got.column(f.name) for f in own.fields], pa.nulls(got.num_rows, pa.string())], names=full.names)
        except Exception as problem:  # any: that is what this is for
            keys = {c: group.column(c)[0].as_py() for c in by}
            return pa.table([pa.array([keys.get(f.name)], f.type) for f in list(arrow)[:-1]] + [pa.array([repr(problem)[:LIMIT]])], names=full.names)

    done = written(rows.groupBy(*by).applyInArrow(run, full), "guarded")
    return Outcome(done.where("error is null").drop("error"), done.where("error is not null").select(*by, "error"))


def report(outcome: Outcome) -> DataFrame:
    """Failures by their reason, and how many there are."""
    return outcome.failures.groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n"))
