"""Date helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso_date(c: Column) -> Column:
    """ISO timestamp text -> date; bad text -> NULL."""
    return F.to_date(c.try_cast("timestamp"))


def parse_dmy(c: Column) -> Column:
    """``dd/MM/yyyy`` text -> date; bad text -> NULL."""
    return F.try_to_date(c, "dd/MM/yyyy")


def parse_year_month(c: Column) -> Column:
    """``yyyy-MM`` text -> first day of that month."""
    return F.to_date(F.concat(c, F.lit("-01")))


def floor_year(c: Column) -> Column:
    return F.trunc(c, "year")


def floor_month(c: Column) -> Column:
    return F.trunc(c, "month")


def ceiling_month(c: Column) -> Column:
    """First day of the next month; a date on the 1st also moves on (the
    boundary rule of the source's month ceiling for dates)."""
    return F.add_months(F.trunc(c, "month"), 1)


def shift_years(c: Column, n: int) -> Column:
    """Minus/plus whole years, clipping to month end."""
    return F.add_months(c, 12 * n)


def shift_months(c: Column, n: int) -> Column:
    return F.add_months(c, n)


def weekday_mon1(c: Column) -> Column:
    """Day of week with Monday = 1 .. Sunday = 7."""
    return F.weekday(c) + 1


def is_weekend(c: Column) -> Column:
    return weekday_mon1(c).isin(6, 7)


# --- driver-side scalar arithmetic on parameters (same rules) --------------

def py_add_months(d: _dt.date, n: int) -> _dt.date:
    """``add_months`` for a Python date: clip to the end of the target month."""
    y, m = divmod(d.month - 1 + n, 12)
    y += d.year
    m += 1
    nxt = _dt.date(y + (m == 12), m % 12 + 1, 1)
    last = (nxt - _dt.timedelta(days=1)).day
    return _dt.date(y, m, min(d.day, last))


def py_floor_year(d: _dt.date) -> _dt.date:
    return _dt.date(d.year, 1, 1)


def py_floor_month(d: _dt.date) -> _dt.date:
    return _dt.date(d.year, d.month, 1)
