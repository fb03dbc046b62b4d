"""Calendar expressions that do not depend on the session time zone.

``timestamp_ntz`` has no zone, but ``unix_timestamp`` and friends cast it
through the session zone first. Going through the date and the clock fields
keeps daylight-saving shifts out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_minutes(t: Column) -> Column:
    return (
        F.unix_date(F.to_date(t)).cast("long") * 1440 + F.hour(t) * 60 + F.minute(t)
    )


def epoch_seconds(t: Column) -> Column:
    return epoch_minutes(t) * 60 + F.second(t)


def ntz_from_minutes(m: Column) -> Column:
    day = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return day + F.make_dt_interval(
        F.floor(m / 1440).cast("int"), F.lit(0), F.pmod(m, F.lit(1440)).cast("int"), F.lit(0)
    )


def floor_minutes(t: Column, step: int) -> Column:
    """Start of the ``step``-minute slot holding ``t``, as epoch minutes."""
    m = epoch_minutes(t)
    return m - F.pmod(m, F.lit(step))


def is_leap(t: Column) -> Column:
    y = F.year(t)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def doy365(t: Column) -> Column:
    """Day of year with 31 December of a leap year folded into day 365."""
    return F.least(F.dayofyear(t), F.lit(365))


def doy_leap_shift(t: Column) -> Column:
    """Day of year on a 365-day axis: later leap-year days move back by one.

    29 February maps to null; callers drop it.
    """
    d = F.dayofyear(t)
    leap_after = is_leap(t) & (d > 60)
    return F.when(is_leap(t) & (d == 60), F.lit(None)).when(leap_after, d - 1).otherwise(d)


def month_of_doy(doy: Column) -> Column:
    """Month holding a day of a non-leap year."""
    return F.month(F.date_add(F.lit("2021-01-01").cast("date"), doy.cast("int") - 1))


def first_doy(month: Column) -> Column:
    return F.dayofyear(F.make_date(F.lit(2021), month.cast("int"), F.lit(1)))


def last_doy(month: Column) -> Column:
    return F.dayofyear(F.last_day(F.make_date(F.lit(2021), month.cast("int"), F.lit(1))))


def iso_minute(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm")


def iso_date(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd")
