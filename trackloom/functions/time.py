"""Time as columns: ISO texts, microseconds, names of sensor files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slack of all window tests, in microseconds (0.1 ms).
SLACK_US = 100


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without time zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def iso_to_micros(text: Column) -> Column:
    """ISO-8601 with offset or Z; null where it is no timestamp."""
    return F.unix_micros(F.try_to_timestamp(text))


def micros_to_iso(us: Column) -> Column:
    """UTC text with +00:00; the fraction only where there is one."""
    ts = F.timestamp_micros(us)
    head = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(head, F.when(us % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def file_time(name: Column) -> Column:
    """The text after the last underscore, without the extension."""
    return F.regexp_extract(name, r"_([^_]+?)(\.[^._]+)?$", 1)


def sequence_key(text: Column) -> Column:
    """Trimmed and padded to six digits."""
    return F.lpad(F.trim(text), 6, "0")


def cleaned(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def short_id(key: Column) -> Column:
    """The first eight characters; ids of born tracks (`silver...`) stay whole, because they would collide."""
    return F.when(key.startswith("silver"), key).otherwise(F.left(key, F.lit(8)))
