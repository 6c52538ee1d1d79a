"""Time columns of events; timestamps are seconds since 1970 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(seconds: Column) -> Column:
    number = seconds.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 1e12), F.timestamp_micros((number * 1_000_000).try_cast("long")))


def time_parts(seconds: Column) -> dict[str, Column]:
    """Hour, day of week (Monday 0) and month; -1 where there is no time. The session's zone must be UTC."""
    at = instant(seconds)
    parts = {"timestamp_hour": F.hour(at), "timestamp_dayofweek": F.weekday(at), "timestamp_month": F.month(at)}
    return {k: F.coalesce(v, F.lit(-1)) for k, v in parts.items()}


def day(seconds: Column) -> Column:
    return F.date_format(instant(seconds), "yyyy-MM-dd")
