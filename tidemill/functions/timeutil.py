"""Event time: windows aligned to the epoch in UTC, hours of the day in Dublin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Dublin"
HOUR, DAY, WEEK = "1 hour", "1 day", "7 days"


def dublin_hour(ts: Column) -> Column:
    """Hour of the day in Dublin, daylight saving included; ``ts`` with or without zone, the session being UTC."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts.cast("timestamp_ntz")))


def tumbling(ts: Column, size: str) -> Column:
    """Window struct; weeks start on Thursdays, as the epoch did."""
    return F.window(ts, size)


def sliding(ts: Column, size: str, slide: str) -> Column:
    return F.window(ts, size, slide)


def parse_instant(text: Column) -> Column:
    """ISO text with milliseconds and an offset as +hhmm, +hh:mm or Z; null if it is not that."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def strict_instant(text: Column) -> Column:
    """Like ``parse_instant``, but an error for anything else."""
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss.SSSZ")


def iso_dublin(ts: Column) -> Column:
    """ISO text of an instant, in Dublin's time."""
    return F.date_format(F.from_utc_timestamp(ts, ZONE), "yyyy-MM-dd'T'HH:mm:ss.SSS")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
