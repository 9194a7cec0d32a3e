"""Dashboard and report queries.

``dashboard_tables`` is the batch job that feeds the dashboard;
``summary_table`` / ``return_curves`` are its two interactive queries;
``forecast_report`` / ``forecast_projection`` shape forecasts for display.
"""

from __future__ import annotations

import datetime as _dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.functions.keys import series_label
from fundlens.functions.numeric import fixed_label, millions_label, percent_label
from fundlens.functions.text import ellipsis
from fundlens.operators.joins import semi
from fundlens.operators.rolling import DAYS_PER_YEAR, clamp_period, multi_period_risk, rolling_generic
from fundlens.operators.runs import DAYS, last_day_stats
from fundlens.operators.universe import active_long_series, filter_latest_date

# --- fixed values: display names of the dashboard tables --------------------
DASHBOARD_FACT_NAMES = [
    "Fecha", "cod", "Participacion", "Rendimientos", "precierre_fondo_dia_t", "Unidades",
    "Valor Unidad", "Valor Cierre", "Inversionistas", "Valor Transacciones", "crecimiento_dia",
]
DASHBOARD_DIM_NAMES = ["cod", "Tipo Entidad", "Nombre Entidad", "Fondo"]
# ---------------------------------------------------------------------------


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Whole-frame rename to display names."""
    return df.toDF(*names)


def title_case(name: str) -> str:
    """First ``_`` -> blank, then title case (``rent_30`` -> ``Rent 30``)."""
    return name.replace("_", " ", 1).title()


def dashboard_tables(panel: DataFrame, dims: DataFrame, min_days: int = 365) -> tuple[DataFrame, DataFrame]:
    """Dashboard facts and dims (J4); the panel's rows may be runs, and the facts then are.

    Facts: active series with more than ``min_days`` rows, display names.
    Dims: only funds present in the facts (semi join), display names.
    """
    facts = active_long_series(panel, min_days)
    facts = rename_all(facts, DASHBOARD_FACT_NAMES + ([DAYS] if DAYS in facts.columns else []))
    d = semi(dims, facts, "cod")
    return facts, rename_all(d, DASHBOARD_DIM_NAMES)


def _last_rows_stats(facts: DataFrame, periods: Sequence[int], sk: Sequence[str], dc: str,
                     col: str) -> DataFrame:
    """Return/volatility on each series' last row, from its last ``max(p)`` rows.

    Equivalent to the trailing-window columns filtered to the last day, but
    planned as a per-series top-``max(p)`` (partial limit before the
    shuffle) and a grouped aggregate on the same partitioning.
    """
    top = max(periods)
    w = Window.partitionBy(*sk).orderBy(F.col(dc).desc())
    ranked = facts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    x = F.col(col)
    aggs = []
    for p in periods:
        inp = F.when(F.col("_rn") <= p, x)
        full = F.count(inp) == p
        gross = F.product(1 + inp)
        aggs.append(F.when(full, F.pow(gross, F.lit(DAYS_PER_YEAR / p)) - 1).alias(f"rent_{p}"))
        aggs.append(F.when(full, F.stddev_samp(inp) * F.lit(math.sqrt(DAYS_PER_YEAR))).alias(f"vol_{p}"))
    return ranked.groupBy(*sk).agg(*aggs)


def summary_table(facts: DataFrame, dims: DataFrame, n1=30, n2=365, titles: bool = False) -> DataFrame:
    """Flagship dashboard table (J5): one row per series on the last day.

    ``facts``/``dims`` are the dashboard tables (display names); facts as
    runs give the same rows without listing a day. Periods
    are clamped to [1, 365] (defaults 30 / 365); equal periods are computed
    once. Columns: entity, fund, participation, ``rent_*``, ``vol_*``,
    close, yield, flow, investors, units, unit value (2 digits).
    """
    p1 = clamp_period(n1, 30)
    p2 = clamp_period(n2, 365)
    periods = [p1] if p1 == p2 else [p1, p2]
    sk, dc = ("cod", "Participacion"), "Fecha"
    last = filter_latest_date(facts, dc)
    # statistics of every series' last rows; the left join from the last-day
    # rows keeps only series present on that day (no extra semi join needed)
    if DAYS in facts.columns:
        stats = last_day_stats(facts, periods, "crecimiento_dia", "Valor Cierre", sk, dc)
    else:
        stats = _last_rows_stats(facts, periods, sk, dc, "crecimiento_dia")
    rows = last.drop("precierre_fondo_dia_t", "crecimiento_dia", DAYS).join(stats, list(sk), "left")
    rows = rows.join(dims.drop("Tipo Entidad"), "cod", "left")
    rent = [f"rent_{p}" for p in periods]
    vol = [f"vol_{p}" for p in periods]
    out = rows.select(
        F.col("Nombre Entidad").alias("nombre_entidad"), F.col("Fondo").alias("fondo"),
        F.col("Participacion").alias("participacion"), *rent, *vol,
        F.col("Valor Cierre").alias("valor_cierre"), F.col("Rendimientos").alias("rendimientos"),
        F.col("Valor Transacciones").alias("valor_transacciones"),
        F.col("Inversionistas").alias("inversionistas"), F.col("Unidades").alias("unidades"),
        F.round(F.col("Valor Unidad"), 2).alias("valor_unidad"),
    )
    if titles:
        names = {"participacion": "Particip."}
        out = out.toDF(*[names.get(c, title_case(c)) for c in out.columns])
    return out


def format_display(summary: DataFrame) -> DataFrame:
    """Display strings of the summary table (S13): ellipsis at 20/30
    characters, ``$ nM`` money, percentages with 2 digits, fixed digits."""
    money = ["valor_cierre", "rendimientos", "valor_transacciones"]
    pct = [c for c in summary.columns if c.startswith(("rent_", "vol_"))]
    cols = {
        "nombre_entidad": ellipsis(F.col("nombre_entidad"), 20),
        "fondo": ellipsis(F.col("fondo"), 30),
        **{c: millions_label(F.col(c)) for c in money},
        **{c: percent_label(F.col(c), 2) for c in pct},
        "inversionistas": fixed_label(F.col("inversionistas"), 0),
        "unidades": fixed_label(F.col("unidades"), 2),
        "valor_unidad": fixed_label(F.col("valor_unidad"), 2, "$"),
    }
    return summary.withColumns(cols)


def cutoff_date(facts: DataFrame, dc: str = "Fecha") -> DataFrame:
    """The date shown in the dashboard title."""
    return facts.agg(F.max(dc).alias("fecha_corte"))


def return_curves(facts: DataFrame, dims: DataFrame, selection: DataFrame, period: int,
                  n1=30, n2=365) -> DataFrame:
    """Return curve of the selected series at one period.

    ``selection`` holds ``(cod, Participacion)`` rows picked from the summary.
    Output ``(fecha, rent, cod_ext)`` with NULL rows dropped.
    """
    p1 = clamp_period(n1, 30)
    p2 = clamp_period(n2, 365)
    periods = [p1] if p1 == p2 else [p1, p2]
    sk = ["cod", "Participacion"]
    chosen = semi(facts, selection, sk)
    risk = multi_period_risk(chosen, periods, sk=sk, dc="Fecha")
    rows = risk.join(dims.drop("Tipo Entidad"), "cod", "left")
    out = rows.select(F.col("Fecha").alias("fecha"), F.col(f"rent_{period}").alias("rent"),
                      series_label(F.col("Fondo"), F.col("Participacion")).alias("cod_ext"))
    return out.dropna()


def forecast_report(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """Actual and predicted rows in one frame with model id / description /
    key / interval bounds (J8, H2)."""
    act = actual.select("cod", "fecha_corte", "creci_dia", "dia_no_habil")
    fc = forecast.select("cod", "fecha_corte", F.col("mean").alias("creci_dia"),
                         F.col("q25").alias("conf_lo"), F.col("q75").alias("conf_hi"))
    both = act.unionByName(fc, allowMissingColumns=True)
    is_actual = F.col("conf_lo").isNull()
    return both.select(
        "cod",
        F.when(is_actual, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("model_id"),
        F.when(is_actual, F.lit("ACTUAL")).otherwise(F.lit("SPARK_TS")).alias("model_desc"),
        F.when(is_actual, F.lit("actual")).otherwise(F.lit("prediction")).alias("key"),
        F.col("fecha_corte").alias("fecha"),
        F.col("creci_dia").alias("value"),
        "conf_lo", "conf_hi", "dia_no_habil",
    )


def forecast_projection(report: DataFrame, as_of: _dt.date, period: int = 30,
                        months: int = 12) -> DataFrame:
    """Rolling annualised return of value and bounds, last ``months`` months."""
    from fundlens.functions.dates import py_add_months

    rolled = rolling_generic(report, ["value", "conf_lo", "conf_hi"], period, value_col="value",
                             sk=("cod",), dc="fecha")
    since = py_add_months(as_of, -months)
    return rolled.where(F.col("fecha") >= F.lit(since))
