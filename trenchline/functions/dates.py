"""Day and time-zone expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

CITY_TZ = "America/Chicago"  # fixed value: the product's time zone


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_day(c: str | Column) -> Column:
    """Day of a city wall-clock timestamp (TIMESTAMP_NTZ): a plain cast."""
    return F.to_date(col_of(c))


def utc_instant_local_day(c: str | Column, tz: str = CITY_TZ) -> Column:
    """Day in ``tz`` of a UTC instant stored without zone (e.g. event time)."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), col_of(c).cast("timestamp_ntz")))


def weekday_name(day: str | Column) -> Column:
    """Full English weekday name ('Tuesday'), like strftime('%A')."""
    return F.date_format(col_of(day), "EEEE")


def as_date(value) -> Column:
    """Literal DATE from 'yyyy-MM-dd', a date, a datetime or a Column."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, _dt.datetime):
        value = value.date()
    if isinstance(value, _dt.date):
        value = value.isoformat()
    return F.to_date(F.lit(str(value)))


def day_start(value) -> Column:
    """Midnight of a day as TIMESTAMP_NTZ (for range filters that push down)."""
    return as_date(value).cast("timestamp_ntz")


def ntz_literal(value) -> Column:
    """TIMESTAMP_NTZ literal from text or a naive datetime."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(str(value)))


def day_range_filter(ts: str | Column, start=None, end=None) -> Column | None:
    """``start <= day(ts) <= end`` written as a half-open range on the raw column,
    so Parquet min/max statistics and row-group pruning apply."""
    cond = None
    c = col_of(ts)
    if start is not None:
        cond = c >= day_start(start)
    if end is not None:
        hi = c < F.date_add(as_date(end), 1).cast("timestamp_ntz")
        cond = hi if cond is None else cond & hi
    return cond
