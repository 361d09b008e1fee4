"""Scalar time functions (SCL-10, 11, 17, 18).

Stored timestamps are ``timestamp_ntz`` read in a UTC session; every helper
keeps results in ``timestamp_ntz`` so that they compare with the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fixed "now" of the test tables: every event lies in 2024-01-01 … 2024-01-30.
DEFAULT_AS_OF = "2024-01-31 00:00:00"


def ts_ntz(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def days_before(as_of: str, days: int) -> Column:
    """SCL-11: ``NOW() - INTERVAL 'n days'`` with ``now`` a parameter."""
    return ts_ntz(as_of) - F.make_dt_interval(F.lit(int(days)))


def within_days(c: Column, as_of: str, days: int) -> Column:
    """FLT-2: the strict trailing window ``c > now - n days``."""
    return c > days_before(as_of, days)


def day_of(c: Column) -> Column:
    """SCL-10: ``DATE_TRUNC('day', c)`` kept as ``timestamp_ntz``."""
    return F.date_trunc("day", c).cast("timestamp_ntz")


def plus_minutes(base: str, minutes: Column) -> Column:
    return ts_ntz(base) + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"), F.lit(0))


def epoch_micros(c: Column) -> Column:
    """Microseconds since the epoch of an NTZ timestamp (UTC session)."""
    return F.unix_micros(c.cast("timestamp"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """SCL-17: ``Date.now() - start`` in whole milliseconds."""
    return F.floor((epoch_micros(end) - epoch_micros(start)) / 1000).cast("long")


def iso_string(c: Column) -> Column:
    """SCL-18: ``toISOString()`` form, UTC, millisecond precision."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
