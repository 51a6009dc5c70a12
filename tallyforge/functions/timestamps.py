"""Timestamps as epoch milliseconds (UTC), and calendar keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
_STRICT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})$"


def strict_ms(text: Column) -> Column:
    """ISO text of exactly one of the four accepted shapes to epoch ms; anything else is null.

    Seconds or milliseconds, ``Z`` or ``+hh:mm`` (at most 18 hours); the date and time must
    exist. A cast alone would also take shorter and longer shapes.
    """
    return F.when(text.rlike(_STRICT), F.unix_millis(F.try_to_timestamp(text)))


def iso_ms(ms: Column) -> Column:
    """Epoch ms to ``yyyy-MM-ddTHH:mm:ss.SSSZ``."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def local_date(ms: Column, timezone: str = "UTC") -> Column:
    """The calendar day of an instant in a time zone, as ``yyyy-MM-dd``."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), timezone), "yyyy-MM-dd")


def floor_hour(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(HOUR_MS))


WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def iso_date(text: Column) -> Column:
    """``yyyy-MM-dd`` text of a day that exists, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def week_start(day: Column, first: str = "sunday") -> Column:
    """The first day of the week of a date; null for null."""
    return F.date_sub(day, F.pmod(F.dayofweek(day) - 1 - WEEKDAYS.index(first), F.lit(7)))


#: Fixed values below: the limits by which sources tell seconds, ms, us and ns apart.


def epoch_ms(number: Column, seconds_below: int) -> Column:
    """A count of seconds, if below a source's own limit, or of milliseconds."""
    return F.when(number < seconds_below, number * 1000).otherwise(number)


def otel_ms(number: Column) -> Column:
    """Seconds, ms, us or ns since the epoch, told apart by magnitude."""
    step = lambda n: F.floor(number / n).cast("long")
    return (
        F.when(number >= 100_000_000_000_000_000, step(1_000_000))
        .when(number >= 100_000_000_000_000, step(1000))
        .when(number >= 100_000_000_000, number)
        .otherwise(number * 1000)
    )


def clock_12(ms: Column, timezone: str = "UTC") -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), timezone), "h a")


def in_days(ts: Column, since: str, until: str, kind: str = "timestamp_ntz") -> Column:
    """Is an instant in the days from ``since`` to ``until``, both included? Compares the column
    itself with two instants, so scans can skip by it."""
    day = lambda x: F.to_date(F.lit(x.replace("-", "")), "yyyyMMdd")
    return (ts >= day(since).cast(kind)) & (ts < F.date_add(day(until), 1).cast(kind))
