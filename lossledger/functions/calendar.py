"""Calendar columns of the date dimension (Sunday = 0 week-day numbering)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_of_week0(d: Column) -> Column:
    """0 = Sunday … 6 = Saturday (Spark's dayofweek is 1 = Sunday)."""
    return (F.dayofweek(d) - 1).cast("int")


def year_quarter(d: Column) -> Column:
    """'YYYY-Qn'."""
    return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def month_name(d: Column) -> Column:
    """Three-letter month name, e.g. 'Jan'."""
    return F.date_format(d, "MMM")


def day_name(d: Column) -> Column:
    """Three-letter day name, e.g. 'Mon'."""
    return F.date_format(d, "E")


def first_of_month(d: Column) -> Column:
    return F.trunc(d, "MM")


def first_of_quarter(d: Column) -> Column:
    return F.trunc(d, "quarter")
