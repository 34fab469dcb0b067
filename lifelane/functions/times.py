"""Instants as microseconds. Differences floor towards minus infinity; calendar midnights play no part."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000
YEAR_DAYS = 365.25


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since 1970; timestamps without zone are read in the session's zone, which should be UTC."""
    return F.unix_micros(col(c).cast("timestamp"))


def instant(c) -> Column:
    """Microseconds back to a timestamp without zone."""
    return F.timestamp_micros(col(c)).cast("timestamp_ntz")


def days(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(DAY))


def floor_days(later, earlier) -> Column:
    return F.floor((micros(later) - micros(earlier)) / F.lit(float(DAY))).cast("long")


def years(later, earlier) -> Column:
    return days(later, earlier) / YEAR_DAYS


def shift(c, amount_micros) -> Column:
    return instant(micros(c) + amount_micros)
