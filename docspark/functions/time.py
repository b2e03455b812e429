"""Dates and times on columns: parsing to UTC, differences, partitions and spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of a span.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}


def iso_utc(text: Column) -> Column:
    """The instant of an ISO 8601 date or timestamp, with its offset if it names one, else UTC; null if it is neither."""
    plain = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd' 'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd' 'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in forms))


def hours_between(start: Column, end: Column, digits: int = 2) -> Column:
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9, digits)


def partition_of(at: Column, unit: str) -> Column:
    """The beginning of the hour, day, month or year."""
    if unit not in ("hour", "day", "month", "year"):
        raise ValueError(f"partitions are by hour, day, month or year, not {unit}")
    return F.date_trunc(unit, at)


def range_bucket(value: Column, start: int, end: int, interval: int) -> Column:
    """The beginning of the value's bucket of an integer range; null outside of [start, end)."""
    return F.when((value >= start) & (value < end), value - F.pmod(value - start, F.lit(interval)))


def seconds_of(span: str) -> int:
    """Seconds of a span such as `90 minutes` or `1 week`."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", span.lower())
    if not m or m[2] not in UNITS or int(m[1]) == 0:
        raise ValueError(f"not a span: {span!r}")
    return int(m[1]) * UNITS[m[2]]
