"""Dates, durations and their formats; the present moment is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_seconds(now: Column, then: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(then)


def run_time(run_id: Column) -> Column:
    """The moment in a run's id (yyyyMMdd-HHmmss-name), or the epoch if it cannot be read."""
    return F.coalesce(F.try_to_timestamp(F.substring(run_id, 1, 15), F.lit("yyyyMMdd-HHmmss")), F.timestamp_seconds(F.lit(0)))


def run_name(run_id: Column) -> Column:
    return F.regexp_replace(run_id, r"^\d{8}-\d{6}-", "")


def span_seconds(c: Column) -> Column:
    """Seconds of a text like 7d, 12h or 30m; an error for any other."""
    n, unit = F.regexp_extract(c, r"^(\d+)([dhm])$", 1), F.regexp_extract(c, r"^(\d+)([dhm])$", 2)
    each = F.when(unit == "d", 86_400).when(unit == "h", 3600).when(unit == "m", 60)
    return F.when(unit == "", F.raise_error(F.concat(F.lit("not a span like 7d, 12h or 30m: "), c)).cast("long")).otherwise(F.try_to_number(n, F.lit("999999999")).cast("long") * each)


def hms(seconds: Column) -> Column:
    """Hours and minutes, rounded down."""
    s = F.floor(seconds)
    return F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s / 60) % 60)


def clock(epoch: Column) -> Column:
    """HH:mm of epoch seconds, ? for none."""
    return F.when(epoch.isNull() | (epoch == 0), "?").otherwise(F.date_format(F.timestamp_seconds(epoch), "HH:mm"))


def minutes(seconds: Column) -> Column:
    return F.floor(seconds / 60)


def speech_minutes(chars: Column, pace: float = 14.0) -> Column:
    return F.round(chars / pace / 60)


def kbps(bits: Column) -> Column:
    return F.floor(bits / 1000)
