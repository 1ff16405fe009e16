"""Date and time column functions.

All are plain Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEEK_KEYS = ("mixed", "iso")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_timestamp(df: DataFrame, col: str = "CreationDate") -> DataFrame:
    """Convert to a timestamp only if the column is not one already.

    Strings such as ``2021-01-05T10:11:12.123`` are cast leniently
    (unparsable -> null, never an error under ANSI mode).
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df
    if isinstance(dtype, T.DateType):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    return df.withColumn(col, lenient_timestamp(col))


def lenient_timestamp(col) -> Column:
    """String -> timestamp without zone; unparsable -> null."""
    return _c(col).cast("string").try_cast("timestamp_ntz")


def lenient_date(col) -> Column:
    """The date part of an ISO string (``…T…``, ``…Z`` or a bare date); bad -> null."""
    return F.substring(_c(col).cast("string"), 1, 10).try_cast("date")


def iso_weekday(col) -> Column:
    """1 = Monday … 7 = Sunday (``weekday`` is 0-based Monday)."""
    return F.weekday(_c(col)) + F.lit(1)


def week_columns(date_col, week_key: str = "mixed") -> dict[str, Column]:
    """``year``, ``week`` and ``yearweek`` of a date column.

    ``mixed`` reproduces the calendar-year * 100 + ISO-week key of the study
    (1-2 Jan 2022 fall into key 202252); ``iso`` uses the ISO week-year.
    """
    if week_key not in WEEK_KEYS:
        raise ValueError(f"week_key must be one of {WEEK_KEYS}")
    d = _c(date_col)
    week = F.weekofyear(d)
    if week_key == "mixed":
        year = F.year(d)
    else:
        year = F.extract(F.lit("YEAROFWEEK"), d)
    return {"year": year, "week": week, "yearweek": year * 100 + week}


def year_month(col) -> Column:
    d = _c(col)
    return F.year(d) * 100 + F.month(d)


def year_quarter(col) -> Column:
    d = _c(col)
    return F.year(d) * 10 + F.quarter(d)


def week_monday(col) -> Column:
    """Monday of the ISO week of a date (calendar week index)."""
    return F.date_trunc("week", _c(col)).cast("date")
