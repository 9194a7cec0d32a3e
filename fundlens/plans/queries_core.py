"""Core registered queries: sources, panel, returns, dashboard."""

from __future__ import annotations

from fundlens.operators.runs import list_days, rolling_runs
from fundlens.plans import oracle as O
from fundlens.plans.catalog import register, sql_select_rounded
from fundlens.plans.report import summary_table

PANEL_COLS = [("fecha_corte", False), ("cod", False), ("tipo_participacion", False),
              ("rendimientos_abonados", True), ("precierre_fondo_dia_t", True),
              ("numero_unidades_fondo_cierre", True), ("valor_unidad_operaciones", True),
              ("valor_fondo_cierre_dia_t", True), ("numero_inversionistas", True),
              ("transaccciones_netas", True)]


# --- A1 scan_facts ---------------------------------------------------------------
register("scan_facts", O.with_ctes(
    [O.PARAMS, O.lines("lines_all", None), O.fact_rows("fact_rows", "lines_all"),
     O.facts("facts", "fact_rows", "y2")],
    sql_select_rounded(PANEL_COLS, "facts")))(lambda ctx: ctx.facts(2, linestatus=None))


# --- F6 clean_panel ----------------------------------------------------------------
@register("clean_panel", O.with_ctes(
    O.panel_chain("y2"),
    sql_select_rounded(PANEL_COLS + [("crecimiento_dia", True)], "panel")))
def _clean_panel(ctx):
    """Merged, padded, filled panel with daily growth (default 2-year range)."""
    return ctx.panel(2, lazy=True)


# --- F10 multi_period_risk ------------------------------------------------------------
_RISK_SQL = O.with_ctes(
    O.panel_chain("y2") + [f"""risk AS (
  SELECT fecha_corte, cod, tipo_participacion, crecimiento_dia,
         {O.rent_sql('crecimiento_dia', 30)} AS rent_30,
         {O.rent_sql('crecimiento_dia', 365)} AS rent_365,
         {O.vol_sql('crecimiento_dia', 30)} AS vol_30,
         {O.vol_sql('crecimiento_dia', 365)} AS vol_365
  FROM panel)"""],
    sql_select_rounded([("fecha_corte", False), ("cod", False), ("tipo_participacion", False),
                        ("crecimiento_dia", True), ("rent_30", True), ("rent_365", True),
                        ("vol_30", True), ("vol_365", True)], "risk"))


@register("multi_period_risk", _RISK_SQL)
def _multi_period_risk(ctx):
    """Annualised 30- and 365-day return and volatility on every panel row."""
    days = list_days(rolling_runs(ctx.runs(2, lazy=True), (30, 365)))
    return days.select("fecha_corte", "cod", "tipo_participacion", "crecimiento_dia", "rent_30", "rent_365", "vol_30", "vol_365")


# --- J4 / J5 dashboard ---------------------------------------------------------------------
def _dashboard_sql() -> list[str]:
    return O.dashboard_chain()


SUMMARY_CTES = _dashboard_sql() + [f"""risk AS (
  SELECT *, {O.rent_sql('crecimiento_dia', 30)} AS rent_30,
         {O.rent_sql('crecimiento_dia', 365)} AS rent_365,
         {O.vol_sql('crecimiento_dia', 30)} AS vol_30,
         {O.vol_sql('crecimiento_dia', 365)} AS vol_365
  FROM dash_facts)""", """summary AS (
  SELECT d.nombre_entidad, d.nombre_patrimonio AS fondo, r.tipo_participacion AS participacion,
         r.rent_30, r.rent_365, r.vol_30, r.vol_365,
         r.valor_fondo_cierre_dia_t AS valor_cierre, r.rendimientos_abonados AS rendimientos,
         r.transaccciones_netas AS valor_transacciones, r.numero_inversionistas AS inversionistas,
         r.numero_unidades_fondo_cierre AS unidades,
         """ + O.r("r.valor_unidad_operaciones", 2) + """ AS valor_unidad
  FROM risk r LEFT JOIN dash_dims d ON d.cod = r.cod
  WHERE r.fecha_corte = (SELECT max(fecha_corte) FROM dash_facts))"""]
_SUMMARY_SQL = O.with_ctes(SUMMARY_CTES,
    sql_select_rounded([("nombre_entidad", False), ("fondo", False), ("participacion", False),
                        ("rent_30", True), ("rent_365", True), ("vol_30", True), ("vol_365", True),
                        ("valor_cierre", True), ("rendimientos", True), ("valor_transacciones", True),
                        ("inversionistas", True), ("unidades", True), ("valor_unidad", True)], "summary"))


@register("summary_table", _SUMMARY_SQL)
def _summary_table(ctx):
    """Flagship: last-day summary of the dashboard universe (periods 30/365)."""
    facts, dims = ctx.dashboard_runs()
    return summary_table(facts, dims, 30, 365)
