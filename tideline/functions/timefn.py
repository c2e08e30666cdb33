"""Columns on clocks: bins, dayparts, zones, wrapping differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, first and last local hour of the dayparts (fixed values).
DAYPARTS = (
    ("window_00_05", 0, 5),
    ("window_06_08", 6, 8),
    ("window_09_11", 9, 11),
    ("window_12_14", 12, 14),
    ("window_15_17", 15, 17),
    ("window_18_20", 18, 20),
    ("window_21_23", 21, 23),
)
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def daypart(hour: Column) -> Column:
    out = F.lit("unknown")
    for name, first, last in reversed(DAYPARTS):
        out = F.when(hour.between(first, last), name).otherwise(out)
    return out


def order_of(values, column: Column) -> Column:
    """Sort key of a fixed category order; unknown values come last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(column == v, i).otherwise(out)
    return out


def bin_floor(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (seconds * 1_000_000)) * seconds)


def day_name(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEEE"), F.lit("unknown"))


def month_key(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM"), F.lit("unknown"))


def quarter_key(ts: Column) -> Column:
    return F.coalesce(F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string")), F.lit("unknown"))


def to_utc(wall: Column, zone: str) -> Column:
    return F.to_utc_timestamp(wall, zone)


def to_local(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds, towards zero."""
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000).cast("long")


def clock_seconds(text: Column) -> Column:
    """HH:MM or HH:MM:SS as seconds of the day; null if it isn't a time."""
    parts = [F.regexp_extract(text, r"^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*$", i) for i in (1, 2, 3)]
    h, m = (p.try_cast("int") for p in parts[:2])
    s = F.when(parts[2] == "", 0).otherwise(parts[2].try_cast("int"))
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)


def wrapped_difference(later: Column, earlier: Column) -> Column:
    """Seconds from earlier to later on a clock, over midnight if need be."""
    return F.pmod(later - earlier, F.lit(86_400))


def circular_distance(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(86_400))
    return F.least(d, 86_400 - d)
