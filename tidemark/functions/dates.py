"""Date columns. Text that is no date becomes NULL, also under ANSI mode."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, TimestampNTZType, TimestampType


def yyyymmdd_to_date(column: Column, data_type: DataType) -> Column:
    """Date of an integer or text ``yyyyMMdd``; a date or timestamp passes through.

    Zero, a wrong number of digits and impossible days become NULL. Whole numbers
    are taken apart by arithmetic: no text is built and no parser runs per row, and
    nothing is raised for a bad value.
    """
    if isinstance(data_type, DateType | TimestampType | TimestampNTZType):
        return column.cast("date")
    if not isinstance(data_type, IntegralType):
        parts = [F.substring(column, 1, 4), F.substring(column, 5, 2), F.substring(column, 7, 2)]
        iso = F.concat(parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2])
        return F.when(column.rlike("^[0-9]{8}$"), iso.try_cast("date"))
    column = column.try_cast("int")
    year, month, day = (column / 10000).cast("int"), (column / 100).cast("int") % 100, column % 100
    month_exists = column.between(10_000_000, 99_999_999) & month.between(1, 12)
    last_day = F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))
    return F.when(month_exists, F.when((day >= 1) & (day <= last_day), F.make_date(year, month, day)))


def iso_to_date(column: Column) -> Column:
    return column.try_cast("date")


def day_before(column: Column) -> Column:
    return F.date_sub(column, 1)


def null_if_after(column: Column, as_of: date | None, data_type: DataType) -> Column:
    """``column``, or NULL of the same type where it lies after ``as_of`` (default today)."""
    limit = F.current_date() if as_of is None else F.lit(as_of)
    return F.when(column.try_cast("date") > limit, F.lit(None).cast(data_type)).otherwise(column)


def timestamp_literal(value: datetime | str, data_type: DataType) -> Column:
    """Literal of the column's own timestamp type, so that a filter reaches the scan."""
    return F.lit(str(value)).cast("timestamp_ntz").cast(data_type)
