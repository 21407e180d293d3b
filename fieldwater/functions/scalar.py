"""Scalar column expressions: missing values, calendars, code lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwater.functions import codes


def finite_or_null(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def nodata_to_null(value: Column, nodata: float = codes.NODATA) -> Column:
    """A value within tolerance of the sentinel, NaN or infinite, becomes NULL."""
    tolerance = 1e-8 + 1e-5 * abs(nodata)
    return F.when(F.abs(value - F.lit(float(nodata))) > tolerance, finite_or_null(value))


def null_to_nodata(value: Column, nodata: float = codes.NODATA) -> Column:
    """NULL, NaN and infinite values become the sentinel of the written grid."""
    return F.coalesce(finite_or_null(value), F.lit(float(nodata)))


def lookup(mapping: Mapping, key: Column, default: Column | None = None) -> Column:
    """Look a key up in a literal map; absent keys give ``default`` or NULL."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, default)


def double_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def month_name(month: Column) -> Column:
    """Abbreviated English month name of a month number, for final presentation only."""
    return F.date_format(F.make_date(F.lit(2001), month, F.lit(1)), "MMM")


def month_end(ts: Column) -> Column:
    return F.last_day(F.to_date(ts))


def days_in_month(year: Column, month: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1))))


def decode_days_since(days: Column, origin: str) -> Column:
    """Date of a "days since <origin>" number."""
    return F.date_add(F.to_date(F.lit(origin)), days.cast("int"))


def season_months(years: DataFrame, start_month: int, end_month: int, year_col: str = "year") -> DataFrame:
    """Rows (year, month) of a season for each requested year.

    A season whose end is not after its start wraps: it begins in the previous
    calendar year, and the earliest requested year is extended backwards.
    """
    y = F.col(year_col)
    wraps = end_month <= start_month
    first = F.make_date(y - F.lit(1 if wraps else 0), F.lit(start_month), F.lit(1))
    last = F.make_date(y, F.lit(end_month), F.lit(1))
    month_start = F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("_m")
    return (
        years.select(month_start)
        .select(F.year("_m").alias("year"), F.month("_m").alias("month"))
        .distinct()
    )


def zero_padded(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def one_of(value: Column, allowed: Iterable, ignore_case: bool = False) -> Column:
    """Membership test, optionally ignoring case. NULL stays NULL."""
    if ignore_case:
        return F.lower(value).isin([str(a).lower() for a in allowed])
    return value.isin(list(allowed))


def contains_text(value: Column, text: str) -> Column:
    return F.lower(value).contains(text.lower())


def is_true(condition: Column) -> Column:
    """Collapse an unknown condition to false, so its negation keeps such rows."""
    return F.coalesce(condition, F.lit(False))
