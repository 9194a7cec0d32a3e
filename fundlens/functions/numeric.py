"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_growth(pre: Column, yld: Column) -> Column:
    """``pre / (pre - yield) - 1``; a zero denominator and a growth that is
    NaN or infinite give 0.

    Spark's ANSI division raises on zero, so that guard comes first; a NULL
    input keeps the result NULL.
    """
    den = pre - yld
    return F.when(den == 0, F.lit(0.0)).otherwise(nan_inf_to(pre / den - 1, 0.0))


def daily_factor(annual_pct: Column, days: int = 365) -> Column:
    """Annual effective percent -> daily growth factor ``(1 + r/100)^(1/days)``."""
    return F.pow(1 + annual_pct / 100, F.lit(1.0 / days))


def annualise(gross: Column, period: int, days: int = 365) -> Column:
    """``gross^(days/period) - 1`` for a gross factor over ``period`` days."""
    return F.pow(gross, F.lit(days / period)) - 1


def nan_inf_to(c: Column, value: float = 0.0) -> Column:
    """Replace NaN and +-Inf by ``value``; NULL stays NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(value)).otherwise(c)


def nan_to_null(c: Column) -> Column:
    """NaN is a missing value: NULL."""
    return F.when(~F.isnan(c), c)


def millions_label(c: Column) -> Column:
    """``$`` + thousands-grouped floor(x / 1e6) + ``M``."""
    return F.concat(F.lit("$"), F.format_number(F.floor(c / 1e6), 0), F.lit("M"))


def percent_label(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(c * 100, digits), F.lit("%"))


def fixed_label(c: Column, digits: int = 2, currency: str = "") -> Column:
    return F.concat(F.lit(currency), F.format_number(c, digits))
