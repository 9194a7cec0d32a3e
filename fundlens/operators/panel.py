"""Regular daily fund panel.

A *series* is the rows of one ``(cod, tipo_participacion)`` ordered by
``fecha_corte``. Cleaning pads every series to one row per calendar day
between its own first and last date, carries balances forward, fills flows
and derives the daily growth.

Plan shape: every step that needs order shares one window spec, so the
whole cleaning costs a single hash exchange on the series key plus sorts;
the padding is an ``explode(sequence)`` over a ``lead`` (no calendar join,
no second shuffle).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions.dates import py_add_months, py_floor_month
from fundlens.functions.numeric import nan_to_null, safe_growth
from fundlens.operators.joins import anti, semi

SERIES = ("cod", "tipo_participacion")
DATE = "fecha_corte"
CARRY = ("valor_fondo_cierre_dia_t", "numero_unidades_fondo_cierre",
         "valor_unidad_operaciones", "numero_inversionistas")
FLOWS = ("rendimientos_abonados", "transaccciones_netas")


def series_window(sk: Sequence[str] = SERIES, dc: str = DATE):
    """Series order. Dates are never NULL past the typed range filter, so one
    ordering spec (ascending) is used everywhere and sorts can be shared."""
    return Window.partitionBy(*sk).orderBy(F.col(dc))


# --- second source: accrual by lag (F1) ---------------------------------------

def accrue_from_rate(report: DataFrame, sk: Sequence[str] = SERIES, dc: str = DATE) -> DataFrame:
    """``precierre = lag(close) * factor``; ``rendimientos = precierre - lag(close)``.

    The first row of each series has no previous close and is dropped.
    Rows with a NULL series key (an unknown subtype) belong to no series:
    they could never match the facts and are dropped first.
    """
    report = report.dropna(subset=list(sk))
    w = series_window(sk, dc)
    prev = F.lag("valor_fondo_cierre_dia_t").over(w)
    rn = F.row_number().over(w)
    out = (report.withColumn("_prev", prev).withColumn("_rn", rn)
           .where(F.col("_rn") > 1)
           .withColumn("precierre_fondo_dia_t", F.col("_prev") * F.col("factor_dia"))
           .withColumn("rendimientos_abonados", F.col("precierre_fondo_dia_t") - F.col("_prev")))
    return out.select(dc, *sk, "rendimientos_abonados", "precierre_fondo_dia_t",
                      "valor_fondo_cierre_dia_t", "numero_inversionistas",
                      "numero_unidades_fondo_cierre", "valor_unidad_operaciones")


def merge_sources(facts: DataFrame, report: DataFrame, as_of: _dt.date,
                  sk: Sequence[str] = SERIES, dc: str = DATE, partitions: int | None = None) -> DataFrame:
    """Stack the report rows under the facts.

    Report rows are accrued by lag within their series (the first row
    dropped), kept only for series seen in the facts since the first day of
    the previous month (D1), and only for days the facts do not already
    hold (D2); their net flow is close minus pre-close (B3).

    Planned as one union and windows on the series key instead of semi /
    anti joins: each source is read once and the whole merge shares the
    single hash partitioning on ``sk`` that the padding uses next
    (partitioning on ``sk`` also satisfies windows keyed on ``sk + more``).
    ``partitions`` fixes the number of its partitions.
    """
    since = py_floor_month(py_add_months(as_of, -1))
    rep = report.dropna(subset=list(sk)).withColumn("_src", F.lit(1))
    u = facts.withColumn("_src", F.lit(0)).unionByName(rep, allowMissingColumns=True)
    if partitions:
        u = u.repartition(partitions, *sk)
    is_rep = F.col("_src") == 1
    # facts rows first, then report rows, each by date: the previous row of
    # a report row is a report row unless it is the first of its series
    w_src = Window.partitionBy(*sk).orderBy(F.col("_src"), F.col(dc))
    u = u.withColumns({"_prev": F.lag("valor_fondo_cierre_dia_t").over(w_src),
                       "_prev_src": F.lag("_src").over(w_src)})
    fact_recent = F.max(F.when(~is_rep & (F.col(dc) >= F.lit(since)), 1).otherwise(0))
    fact_same_day = F.max(F.when(~is_rep, 1).otherwise(0))
    u = u.withColumns({"_recent": fact_recent.over(Window.partitionBy(*sk)),
                       "_same_day": fact_same_day.over(Window.partitionBy(*sk, dc))})
    keep = ~is_rep | ((F.col("_prev_src") == 1) & (F.col("_recent") == 1) & (F.col("_same_day") == 0))
    pre = F.col("_prev") * F.col("factor_dia")
    u = u.where(keep).withColumns({
        "precierre_fondo_dia_t": F.when(is_rep, pre).otherwise(F.col("precierre_fondo_dia_t")),
        "rendimientos_abonados": F.when(is_rep, pre - F.col("_prev")).otherwise(F.col("rendimientos_abonados")),
    })
    u = u.withColumn("transaccciones_netas", F.when(
        is_rep, F.col("valor_fondo_cierre_dia_t") - F.col("precierre_fondo_dia_t")).otherwise(
        F.col("transaccciones_netas")))
    return u.select(*facts.columns)


# --- padding and filling (F2-F4) ------------------------------------------------

def locf(df: DataFrame, cols: Sequence[str] = CARRY, sk: Sequence[str] = SERIES,
         dc: str = DATE) -> DataFrame:
    """Last observation carried forward within each series (F3); leading NULLs stay."""
    w = series_window(sk, dc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def pad_daily(df: DataFrame, carry: Sequence[str] = CARRY, sk: Sequence[str] = SERIES,
              dc: str = DATE, fill_carry: bool = True) -> DataFrame:
    """One row per day between each series' first and last date (F2).

    Each observed row is exploded over the days up to the next observation.
    Added days get NULL in every column except the keys and, when
    ``fill_carry``, the carried columns, which take the last observed value
    -- identical to padding first and then carrying forward (F3), since the
    carry is evaluated on the observed rows before the explode.
    """
    w = series_window(sk, dc)
    nxt = F.lead(dc).over(w)
    if fill_carry:
        wc = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.withColumns({c: F.last(c, ignorenulls=True).over(wc) for c in carry})
    df = df.withColumn("_next", nxt)
    days = F.sequence(F.col(dc), F.coalesce(F.date_sub("_next", 1), F.col(dc)))
    df = df.withColumn("_day", F.explode(days))
    added = F.col("_day") != F.col(dc)
    keep = set(sk) | (set(carry) if fill_carry else set())
    cols = []
    for c in df.columns:
        if c in ("_next", "_day", dc):
            continue
        cols.append(F.col(c) if c in keep else F.when(added, F.lit(None)).otherwise(F.col(c)).alias(c))
    return df.select(F.col("_day").alias(dc), *cols)


def fill_flows(df: DataFrame) -> DataFrame:
    """Missing (NULL or NaN) flows -> 0; missing pre-close -> closing value."""
    return df.withColumns({
        "rendimientos_abonados": F.coalesce(nan_to_null(F.col("rendimientos_abonados")), F.lit(0.0)),
        "transaccciones_netas": F.coalesce(nan_to_null(F.col("transaccciones_netas")), F.lit(0.0)),
        "precierre_fondo_dia_t": F.coalesce(nan_to_null(F.col("precierre_fondo_dia_t")), "valor_fondo_cierre_dia_t"),
    })


def daily_growth(df: DataFrame) -> DataFrame:
    """Round yield and pre-close to 1 decimal; ``g = pre / (pre - yield) - 1``.

    A growth that is not finite gives 0, NULL stays NULL.
    """
    df = df.withColumns({
        "rendimientos_abonados": F.round("rendimientos_abonados", 1),
        "precierre_fondo_dia_t": F.round("precierre_fondo_dia_t", 1),
    })
    return df.withColumn("crecimiento_dia",
                         safe_growth(F.col("precierre_fondo_dia_t"), F.col("rendimientos_abonados")))


PANEL_ORDER = ("fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados",
               "precierre_fondo_dia_t", "numero_unidades_fondo_cierre", "valor_unidad_operaciones",
               "valor_fondo_cierre_dia_t", "numero_inversionistas", "transaccciones_netas",
               "crecimiento_dia")


def clean_panel(facts: DataFrame, report: DataFrame | None = None,
                as_of: _dt.date | None = None) -> DataFrame:
    """The whole cleaning (F6): merge sources, pad, carry, fill, growth."""
    rows = facts if report is None else merge_sources(facts, report, as_of)
    panel = daily_growth(fill_flows(pad_daily(rows)))
    return panel.select(*PANEL_ORDER)
