"""Time functions on columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_time(value: Column) -> Column:
    """Timestamp without zone, or null when the text is no timestamp."""
    return value.cast("string").try_cast("timestamp_ntz")


def to_day(value: Column) -> Column:
    return F.to_date(value)


def week_end(value: Column) -> Column:
    """The Sunday that closes the week of a timestamp."""
    return F.date_add(F.to_date(F.date_trunc("week", value)), 6)


def days_before(as_of: datetime | str, days: int) -> Column:
    """Start of the period of ``days`` days that ends at ``as_of``."""
    return F.lit(str(as_of)).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
