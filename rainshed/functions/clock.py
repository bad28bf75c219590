"""Wall-clock arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 on the clock the timestamp shows; no daylight-saving jumps."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def utc_instant(ts: Column) -> Column:
    """Instant at which a UTC clock shows the timestamp (event time for streams)."""
    return F.timestamp_micros(wall_micros(ts))


def utc_date(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))
