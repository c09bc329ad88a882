"""Scalar expressions shared by the analyses. All of them stay JVM-side."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_of_date(as_of: dt.date | None = None) -> Column:
    """The reference date: a literal when given, else the day the query runs."""
    return F.lit(as_of) if as_of is not None else F.current_date()


def month_of(date: Column | str) -> Column:
    """``YYYY-MM``. A missing date is a group of its own, named ``NaT``."""
    return F.coalesce(F.date_format(col(date), "yyyy-MM"), F.lit("NaT"))


def _time_of_day(moment: Column) -> Column:
    wall = moment.cast("timestamp_ntz")
    return F.hour(wall) * 3600 + F.minute(wall) * 60 + F.extract(F.lit("SECOND"), wall)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole elapsed days, floored: two hours across midnight are 0 days, minus one hour is -1.

    Wall-clock arithmetic, so a change to or from summer time does not shift the result.
    """
    incomplete = _time_of_day(col(later)) < _time_of_day(col(earlier))
    return F.datediff(col(later), col(earlier)) - incomplete.cast("int")


def elapsed_days(df: DataFrame, later: Column | str, earlier: Column | str) -> Column:
    """``days_between``, shortened to a plain date difference when only pure dates are involved."""
    kinds = dict(df.dtypes)
    if all(kinds[c] == "date" for c in (later, earlier) if isinstance(c, str)):
        return F.datediff(col(later), col(earlier))
    return days_between(later, earlier)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Double division that gives null, not an error, on a zero denominator."""
    return F.try_divide(col(part).cast("double"), col(whole).cast("double"))


def round_even(value: Column, digits: int = 2) -> Column:
    """Half-even rounding."""
    return F.bround(value, digits)


def pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``, rounded half-even."""
    return round_even(ratio(part, whole) * 100, digits)


def sum_or_zero(value: Column | str) -> Column:
    """Sum where a group with no value at all counts 0."""
    return F.coalesce(F.sum(col(value)), F.lit(0))


def mean(value: Column | str) -> Column:
    """Mean of the non-null values as sum / count.

    Integers and decimals are summed exactly, so the result does not depend on the order in
    which partitions are merged.
    """
    return ratio(F.sum(col(value)), F.count(col(value)))


def mean_pct(flag: Column | str, digits: int = 2) -> Column:
    """Share of a 0/1 flag in percent."""
    return round_even(mean(flag) * 100, digits)


def is_in(value: Column | str, values: Iterable[str]) -> Column:
    """0/1 membership flag; a null value is no member."""
    return F.coalesce(col(value).isin(*values), F.lit(False)).cast("int")


def not_in(value: Column | str, values: Iterable[str]) -> Column:
    """True outside ``values``; a null value is outside as well."""
    return col(value).isNull() | ~col(value).isin(*values)


def at_or_after(moment: Column | str, event: Column | str) -> Column:
    """True when ``event`` happened at or before ``moment``; a missing date gives False."""
    return F.coalesce(col(event).isNotNull() & (col(moment) >= col(event)), F.lit(False))


def utilization_pct(spend: Column | str, limit: Column | str) -> Column:
    """Spend as a percentage of the limit; null unless the limit is positive."""
    return F.when(col(limit) > 0, pct(spend, limit))


def normalized(text: Column | str) -> Column:
    return F.lower(F.trim(col(text)))
