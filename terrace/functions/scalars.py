"""Column expressions. All are built-in Spark expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Trim spaces; nothing left means NULL."""
    return F.nullif(F.trim(_column(c)), F.lit(""))


def clock_text(c: str | Column) -> Column:
    """Clock text as four digits: '5' is '0005', '9:05' is '0905'; NULL when there is no digit."""
    digits = F.regexp_replace(F.trim(_column(c)), "[^0-9]", "")
    return F.lpad(F.nullif(digits, F.lit("")), 4, "0")


def tolerant(c: str | Column, sql_type: str) -> Column:
    """Cast that yields NULL for unreadable or out-of-range input, also under ANSI mode."""
    return _column(c).try_cast(sql_type)


def date_key(c: str | Column) -> Column:
    """Integer yyyymmdd, by arithmetic rather than by formatting text."""
    d = _column(c)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """100 * part / whole, rounded; NULL when the whole is zero."""
    return F.round(F.try_divide(F.lit(100) * part, whole), digits)


def mean(total: Column, count: Column) -> Column:
    """total / count; NULL when nothing was counted."""
    return F.try_divide(total, count)


def utc_wall_clock(c: str | Column) -> Column:
    """The UTC wall-clock reading (without zone) of an instant, whatever the session time zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), _column(c).cast("timestamp_ntz"))
