"""Registered queries for sources/sinks, projections, filters, joins, set
operations, sorts and scalar functions (SURVEY 2.1-2.3, 2.5, 2.8-2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fundlens.functions.dates import (ceiling_month, floor_month, floor_year, is_weekend,
                                      parse_dmy, parse_iso_date, parse_year_month, shift_months,
                                      shift_years, weekday_mon1)
from fundlens.functions.keys import series_label
from fundlens.functions.numeric import annualise
from fundlens.functions.text import classify_entity_type, clean_fund_name, entity_key
from fundlens.operators.columns import across_columns, select_by_prefix
from fundlens.operators.joins import anti, left_lookup, natural_left, semi
from fundlens.operators.panel import accrue_from_rate, daily_growth, merge_sources
from fundlens.operators.rolling import multi_period_risk
from fundlens.operators.runs import rolling_days
from fundlens.operators.universe import (best_config, extreme_per_group, filter_exclude_period,
                                         filter_latest_date, filter_recent_calendar, first_per_group)
from fundlens.plans import oracle as O
from fundlens.plans.catalog import register, sql_select_rounded
from fundlens.plans.report import DASHBOARD_DIM_NAMES, DASHBOARD_FACT_NAMES, format_display, rename_all, summary_table
from fundlens.sources import adapter
from fundlens.sources.landed import (FACT_COLUMNS, filter_between_notin, holidays, macro_daily,
                                     macro_monthly, net_flows, read_dashboard, typed_facts,
                                     with_composite_key, write_dashboard)

PANEL = ["fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t",
         "numero_unidades_fondo_cierre", "valor_unidad_operaciones", "valor_fondo_cierre_dia_t",
         "numero_inversionistas", "transaccciones_netas", "crecimiento_dia"]
NUM = set(PANEL[3:]) | {"aportes_recibidos", "retiros_redenciones", "anulaciones", "factor_dia",
                        "rent_30", "rent_365", "vol_30", "vol_365", "trm", "ipc", "creci_dia",
                        "mean", "actual", "anual", "raiz", "magnitud", "redondeado"}


def cols(names):
    return [(c, c in NUM) for c in names]


def sel(names, src, where=""):
    return sql_select_rounded(cols(names), src, where)


RAW_ALL = [O.PARAMS, O.lines("lines_all", None), O.fact_rows("fact_rows", "lines_all")]
FACT_ROW_COLS = list(FACT_COLUMNS)
REPORT_COLS = ["fecha_corte", "cod", "tipo_participacion", "valor_fondo_cierre_dia_t",
               "numero_inversionistas", "factor_dia", "numero_unidades_fondo_cierre",
               "valor_unidad_operaciones"]
ACC_COLS = ["fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t",
            "valor_fondo_cierre_dia_t", "numero_inversionistas", "numero_unidades_fondo_cierre",
            "valor_unidad_operaciones"]
REPORT_CHAIN = [O.PARAMS, O.lines("lines_o", "O"), O.report("rep", "lines_o"),
                O.report_accrued("rep_acc", "rep")]
FACTS2_REPORT_CHAIN = [O.PARAMS, O.lines("lines_f", "F"), O.lines("lines_o", "O"),
                       O.fact_rows("fact_rows", "lines_f"), O.facts("facts", "fact_rows", "y2"),
                       O.report("rep", "lines_o"), O.report_accrued("rep_acc", "rep")]
for c in FACT_ROW_COLS:
    if c not in ("fecha_corte", "tipo_entidad", "codigo_entidad", "subtipo_negocio", "codigo_negocio",
                 "tipo_participacion"):
        NUM.add(c)


# ============================== 2.1 sources and sinks ==============================

register("scan_dims", O.with_ctes([O.PARAMS] + O.dims_chain()[:1], "SELECT * FROM dims_raw"))(
    lambda ctx: ctx.dims_raw(2))

register("typed_facts", O.with_ctes(RAW_ALL, sel(FACT_ROW_COLS, "fact_rows")))(
    lambda ctx: typed_facts(adapter.fund_rows_text(ctx.spark, ctx.sf_dir, None)))

register("scan_report", O.with_ctes([O.PARAMS, O.lines("lines_o", "O"), O.report("rep", "lines_o")],
                                    sel(REPORT_COLS, "rep")))(lambda ctx: ctx.report())

_TRM = """trm AS (
  SELECT CAST(o_orderdate AS DATE) AS fecha,
         CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS trm
  FROM orders GROUP BY 1)"""
_IPC = """ipc_m AS (
  SELECT CAST(strftime(o_orderdate, '%Y-%m') || '-01' AS DATE) AS fecha,
         CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS ipc
  FROM orders GROUP BY 1),
ipc_b AS (
  SELECT fecha, ipc,
         coalesce(lead(fecha) OVER (ORDER BY fecha) - 1, CAST(fecha + INTERVAL 1 MONTH AS DATE)) AS fin
  FROM ipc_m),
ipc AS (SELECT fecha + CAST(unnest(range(0, fin - fecha + 1)) AS INTEGER) AS fecha, ipc FROM ipc_b)"""
_FEST = """festivos AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS fecha, TRUE AS festivo
  FROM orders WHERE dayofmonth(o_orderdate) = 1)"""

register("scan_macro", O.with_ctes([_TRM], sel(["fecha", "trm"], "trm")))(
    lambda ctx: macro_daily(adapter.trm_rows(ctx.spark, ctx.sf_dir)))
register("scan_index_monthly", O.with_ctes([_IPC], sel(["fecha", "ipc"], "ipc")))(
    lambda ctx: macro_monthly(adapter.ipc_rows(ctx.spark, ctx.sf_dir)))
register("scan_holidays", O.with_ctes([_FEST], "SELECT fecha, festivo FROM festivos"))(
    lambda ctx: holidays(adapter.holiday_rows(ctx.spark, ctx.sf_dir)))

_DASH_FACT_SQL = ", ".join(
    f'{O.r8(src)} AS "{dst}"' if src in NUM else f'{src} AS "{dst}"'
    for src, dst in zip(PANEL, DASHBOARD_FACT_NAMES))
_DASH_DIM_SQL = ", ".join(f'{src} AS "{dst}"' for src, dst in zip(
    ["cod", "nombre_tipo_entidad", "nombre_entidad", "nombre_patrimonio"], DASHBOARD_DIM_NAMES))


@register("sink_dashboard", O.with_ctes(O.dashboard_chain(), f"SELECT {_DASH_FACT_SQL} FROM dash_facts"))
def _sink_dashboard(ctx):
    """Write the dashboard tables (Parquet, facts by year) and read the facts back."""
    facts, dims = ctx.dashboard()
    path = ctx.scratch_path("dashboard")
    write_dashboard(facts, dims, path)
    return read_dashboard(ctx.spark, path)[0]


@register("read_dashboard", O.with_ctes(O.dashboard_chain(), f"SELECT {_DASH_DIM_SQL} FROM dash_dims"))
def _read_dashboard(ctx):
    """Dims table of the dashboard after a write / read round trip."""
    facts, dims = ctx.dashboard()
    path = ctx.scratch_path("dashboard")
    write_dashboard(facts, dims, path)
    return read_dashboard(ctx.spark, path)[1]


# ============================== 2.2 projections ==============================

register("composite_key", O.with_ctes(RAW_ALL, """SELECT fecha_corte,
  coalesce(tipo_entidad, 'NA') || '_' || coalesce(codigo_entidad, 'NA') || '_' ||
  coalesce(subtipo_negocio, 'NA') || '_' || coalesce(codigo_negocio, 'NA') AS cod, tipo_participacion
  FROM fact_rows"""))(lambda ctx: with_composite_key(ctx.fact_rows(None)).select(
        "fecha_corte", "cod", "tipo_participacion"))

_NET_COLS = [c for c in FACT_ROW_COLS if c not in ("aportes_recibidos", "retiros_redenciones", "anulaciones")]
register("net_flows", O.with_ctes(RAW_ALL + ["""nf AS (SELECT *,
  aportes_recibidos - retiros_redenciones + anulaciones AS transaccciones_netas FROM fact_rows)"""],
    sel(_NET_COLS + ["transaccciones_netas"], "nf")))(lambda ctx: net_flows(ctx.fact_rows(None)))

register("net_flows_from_balance", O.with_ctes(REPORT_CHAIN, sel(
    ["fecha_corte", "cod", "tipo_participacion", "transaccciones_netas"],
    "(SELECT *, valor_fondo_cierre_dia_t - precierre_fondo_dia_t AS transaccciones_netas FROM rep_acc) t")))(
    lambda ctx: accrue_from_rate(ctx.report()).select(
        "fecha_corte", "cod", "tipo_participacion",
        (F.col("valor_fondo_cierre_dia_t") - F.col("precierre_fondo_dia_t")).alias("transaccciones_netas")))

register("rename_all", O.with_ctes(O.dashboard_chain(), f"SELECT {_DASH_FACT_SQL} FROM dash_facts"))(
    lambda ctx: ctx.dashboard()[0])

_MONEY = ["rendimientos_abonados", "precierre_fondo_dia_t", "valor_fondo_cierre_dia_t",
          "transaccciones_netas"]
register("across_columns", O.with_ctes(O.panel_chain("y2"), "SELECT " + ", ".join(
    (O.r(c, 2) if c in _MONEY else (O.r8(c) if c in NUM else c)) + f" AS {c}" for c in PANEL) + " FROM panel"))(
    lambda ctx: across_columns(ctx.panel(2), _MONEY, lambda c: F.round(c, 2)))

_RISK_CTE = f"""risk AS (
  SELECT *, {O.rent_sql('crecimiento_dia', 30)} AS rent_30,
         {O.rent_sql('crecimiento_dia', 365)} AS rent_365,
         {O.vol_sql('crecimiento_dia', 30)} AS vol_30,
         {O.vol_sql('crecimiento_dia', 365)} AS vol_365
  FROM panel)"""
register("select_by_prefix", O.with_ctes(O.panel_chain("y2") + [_RISK_CTE], sel(
    ["fecha_corte", "cod", "tipo_participacion", "rent_30", "rent_365", "vol_30", "vol_365"], "risk")))(
    lambda ctx: select_by_prefix(multi_period_risk(ctx.panel(2), (30, 365)),
                                 ["fecha_corte", "cod", "tipo_participacion"], "rent", "vol"))


@register("series_label", O.with_ctes(O.dashboard_chain(), """SELECT DISTINCT f.cod,
  f.tipo_participacion AS "Participacion", d.nombre_patrimonio || '/' || f.tipo_participacion AS cod_ext
  FROM dash_facts f LEFT JOIN dash_dims d ON d.cod = f.cod"""))
def _series_label(ctx):
    facts, dims = ctx.dashboard()
    j = left_lookup(facts, dims, "cod", drop=["Tipo Entidad"])
    return j.select("cod", "Participacion",
                    series_label(F.col("Fondo"), F.col("Participacion")).alias("cod_ext")).distinct()


# ============================== 2.3 filters ==============================

register("filter_between_notin", O.with_ctes(RAW_ALL, sel(
    FACT_ROW_COLS, "fact_rows, params",
    "WHERE fecha_corte BETWEEN params.y1 AND params.as_of AND subtipo_negocio NOT IN ('7', '3')")))(
    lambda ctx: filter_between_notin(ctx.fact_rows(None), ctx.years_back(1), ctx.as_of, ("7", "3")))

register("filter_latest_date", O.with_ctes(O.panel_chain("y2"), sel(
    PANEL, "panel", "WHERE fecha_corte = (SELECT max(fecha_corte) FROM panel)")))(
    lambda ctx: filter_latest_date(ctx.panel(2)))

register("filter_recent_calendar", O.with_ctes(O.panel_chain("y2"), sel(
    PANEL, "panel, params", "WHERE fecha_corte >= params.y1")))(
    lambda ctx: filter_recent_calendar(ctx.panel(2), ctx.years_back(1)))

SHOCK = ("2000-03-01", "2000-04-01")  # a shock interval inside the tables' date range
register("filter_exclude_period", O.with_ctes(O.panel_chain("y2"), sel(
    PANEL, "panel",
    f"WHERE fecha_corte <= DATE '{SHOCK[0]}' OR fecha_corte >= DATE '{SHOCK[1]}'")))(
    lambda ctx: filter_exclude_period(ctx.panel(2), *SHOCK))

_RISK_COLS = PANEL + ["rent_30", "rent_365", "vol_30", "vol_365"]
register("drop_nulls", O.with_ctes(O.panel_chain("y2") + [_RISK_CTE], sel(
    _RISK_COLS, "risk", "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _RISK_COLS))))(
    lambda ctx: rolling_days(ctx.runs(2), (30, 365), full=True).dropna())


# ============================== 2.5 joins ==============================

register("semi_recent_keys", O.with_ctes(FACTS2_REPORT_CHAIN, sel(ACC_COLS, "rep_acc a, params", """WHERE
  EXISTS (SELECT 1 FROM facts f WHERE f.fecha_corte >= params.m1 AND f.cod = a.cod
          AND f.tipo_participacion = a.tipo_participacion)""")))(
    lambda ctx: semi(accrue_from_rate(ctx.report()),
                     ctx.facts(2).where(F.col("fecha_corte") >= F.lit(_month_back(ctx))),
                     ["cod", "tipo_participacion"]))


def _month_back(ctx):
    from fundlens.functions.dates import py_add_months, py_floor_month
    return py_floor_month(py_add_months(ctx.as_of, -1))


register("anti_existing", O.with_ctes(FACTS2_REPORT_CHAIN, sel(ACC_COLS, "rep_acc a", """WHERE
  NOT EXISTS (SELECT 1 FROM facts f WHERE f.fecha_corte = a.fecha_corte AND f.cod = a.cod
              AND f.tipo_participacion = a.tipo_participacion)""")))(
    lambda ctx: anti(accrue_from_rate(ctx.report()), ctx.facts(2), ["fecha_corte", "cod", "tipo_participacion"]))

register("semi_in_list", O.with_ctes(O.dashboard_chain(), "SELECT * FROM dash_dims"))(
    lambda ctx: semi(ctx.dims(2), ctx.dashboard()[0], "cod"))

register("left_dims", O.with_ctes(O.dashboard_chain(), sel(
    PANEL + ["nombre_entidad", "nombre_patrimonio"],
    "(SELECT f.*, d.nombre_entidad, d.nombre_patrimonio FROM dash_facts f "
    "LEFT JOIN dash_dims d ON d.cod = f.cod) t")))(
    lambda ctx: left_lookup(rename_all(ctx.dashboard()[0], PANEL), ctx.dims(2), "cod",
                            drop=["nombre_tipo_entidad"]))

_MACRO_SQL = O.with_ctes(O.base5_chain() + [_TRM, _IPC, _FEST], sel(
    ["cod", "fecha_corte", "crecimiento_dia", "trm", "ipc", "festivo"],
    """(SELECT b.cod, b.fecha_corte, b.crecimiento_dia, t.trm, i.ipc, coalesce(h.festivo, FALSE) AS festivo
        FROM base5 b LEFT JOIN trm t ON t.fecha = b.fecha_corte LEFT JOIN ipc i ON i.fecha = b.fecha_corte
        LEFT JOIN festivos h ON h.fecha = b.fecha_corte) t"""))


@register("left_macro", _MACRO_SQL)
def _left_macro(ctx):
    from fundlens.operators.forecast import join_macro
    base = ctx.base5().select("cod", "fecha_corte", "crecimiento_dia")
    return join_macro(base, adapter.trm_rows(ctx.spark, ctx.sf_dir), adapter.ipc_rows(ctx.spark, ctx.sf_dir),
                      adapter.holiday_rows(ctx.spark, ctx.sf_dir))


register("natural_left", O.with_ctes(O.panel_chain("y2") + [
    "cnt AS (SELECT cod, tipo_participacion, count(*) AS n FROM panel GROUP BY ALL)"],
    sel(PANEL + ["n"], "panel LEFT JOIN cnt USING (cod, tipo_participacion)")))(
    lambda ctx: natural_left(ctx.panel(2), ctx.panel(2).groupBy("cod", "tipo_participacion")
                             .agg(F.count(F.lit(1)).alias("n"))))


@register("semi_selection", O.with_ctes(O.dashboard_chain(), f"""SELECT {_DASH_FACT_SQL} FROM dash_facts
  WHERE (cod, tipo_participacion) IN (
    SELECT cod, tipo_participacion FROM dash_facts
    WHERE fecha_corte = (SELECT max(fecha_corte) FROM dash_facts) AND transaccciones_netas > 0)"""))
def _semi_selection(ctx):
    facts, _ = ctx.dashboard()
    picked = filter_latest_date(facts, "Fecha").where(F.col("Valor Transacciones") > 0)
    return semi(facts, picked, ["cod", "Participacion"])


# ============================== 2.8 sorts, limits, distinct ==============================

register("order_panel", O.with_ctes(O.panel_chain("y2"), sel(PANEL, "panel") +
                                    " ORDER BY cod, tipo_participacion, fecha_corte"))(
    lambda ctx: ctx.panel(2).orderBy(F.col("cod").asc_nulls_last(), F.col("tipo_participacion").asc_nulls_last(),
                                     F.col("fecha_corte").asc_nulls_last()))

register("head_n", O.with_ctes(O.panel_chain("y2"), sel(PANEL, "panel") +
                               " ORDER BY cod, tipo_participacion, fecha_corte LIMIT 6"))(
    lambda ctx: ctx.panel(2).orderBy("cod", "tipo_participacion", "fecha_corte").limit(6))

register("first_per_group", O.with_ctes(O.panel_chain("y2"), sel(PANEL, """(SELECT *, row_number() OVER
  (PARTITION BY cod ORDER BY tipo_participacion) AS rn FROM panel
  WHERE fecha_corte = (SELECT max(fecha_corte) FROM panel)) t""", "WHERE rn = 1")))(
    lambda ctx: first_per_group(filter_latest_date(ctx.panel(2)), ["cod"], [F.col("tipo_participacion")]))

register("extreme_per_group", O.with_ctes(O.panel_chain("y2"), sel(PANEL, """(SELECT *,
  max(numero_inversionistas) OVER (PARTITION BY cod) AS mx FROM panel
  WHERE fecha_corte = (SELECT max(fecha_corte) FROM panel)) t""", "WHERE numero_inversionistas = mx")))(
    lambda ctx: extreme_per_group(filter_latest_date(ctx.panel(2)), ["cod"], "numero_inversionistas"))

register("best_config", O.with_ctes(O.panel_chain("y2"), """SELECT cod || '/' || tipo_participacion AS n,
  count(*) FILTER (WHERE crecimiento_dia > 0) AS silhouette FROM panel GROUP BY ALL
  ORDER BY silhouette DESC, n DESC LIMIT 1"""))(
    lambda ctx: best_config(ctx.panel(2).groupBy(
        F.concat_ws("/", "cod", "tipo_participacion").alias("n")).agg(
        F.count(F.when(F.col("crecimiento_dia") > 0, 1)).alias("silhouette"))))

register("distinct_rows", O.with_ctes(RAW_ALL, """SELECT DISTINCT
  coalesce(tipo_entidad, 'NA') || '_' || coalesce(codigo_entidad, 'NA') || '_' ||
  coalesce(subtipo_negocio, 'NA') || '_' || coalesce(codigo_negocio, 'NA') AS cod, tipo_participacion
  FROM fact_rows"""))(lambda ctx: with_composite_key(ctx.fact_rows(None)).select(
        "cod", "tipo_participacion").distinct())


# ============================== 2.9 set operations ==============================

_MERGED_COLS = PANEL[:-1]
register("union_sources", O.with_ctes(O.panel_chain("y2")[:-1], sel(_MERGED_COLS, "merged")))(
    lambda ctx: merge_sources(ctx.facts(2), ctx.report(), ctx.as_of).select(*_MERGED_COLS))


# ============================== 2.10 scalar functions ==============================

register("str_classify", O.with_ctes([O.PARAMS] + O.dims_chain()[:1], f"""SELECT DISTINCT
  nombre_tipo_entidad AS nombre_original,
  {O.entity_label('nombre_tipo_entidad')} AS nombre_tipo_entidad FROM dims_raw"""))(
    lambda ctx: ctx.dims_raw(2).select(
        F.col("nombre_tipo_entidad").alias("nombre_original"),
        classify_entity_type(F.col("nombre_tipo_entidad")).alias("nombre_tipo_entidad")).distinct())

register("str_extract", O.with_ctes([O.PARAMS] + O.dims_chain(), """SELECT DISTINCT cod,
  regexp_extract(cod, '""" + O.ENTITY_KEY_PATTERN + """') AS cod_empresa FROM dims"""))(
    lambda ctx: ctx.dims(2).select("cod", entity_key(F.col("cod")).alias("cod_empresa")).distinct())

register("str_clean_name", O.with_ctes([O.PARAMS] + O.dims_chain()[:1], f"""SELECT DISTINCT
  nombre_patrimonio AS nombre_original,
  {O.fund_name('nombre_patrimonio')} AS nombre_patrimonio FROM dims_raw"""))(
    lambda ctx: ctx.dims_raw(2).select(
        F.col("nombre_patrimonio").alias("nombre_original"),
        clean_fund_name(F.col("nombre_patrimonio")).alias("nombre_patrimonio")).distinct())

register("str_digits", O.with_ctes([O.PARAMS, O.lines("lines_o", "O"), O.report("rep", "lines_o")], sel(
    ["fecha_corte", "cod", "tipo_participacion", "valor_fondo_cierre_dia_t", "numero_unidades_fondo_cierre",
     "valor_unidad_operaciones"], "rep")))(
    lambda ctx: ctx.report().select("fecha_corte", "cod", "tipo_participacion", "valor_fondo_cierre_dia_t",
                                    "numero_unidades_fondo_cierre", "valor_unidad_operaciones"))

register("str_concat", O.with_ctes([O.PARAMS, O.lines("lines_o", "O"), O.report("rep", "lines_o")],
                                   "SELECT fecha_corte, cod, tipo_participacion FROM rep"))(
    lambda ctx: ctx.report().select("fecha_corte", "cod", "tipo_participacion"))

register("lookup_names", O.with_ctes([O.PARAMS] + O.dims_chain(),
                                     "SELECT DISTINCT cod, nombre_entidad FROM dims"))(
    lambda ctx: ctx.dims(2).select("cod", "nombre_entidad").distinct())


@register("date_parse", O.with_ctes(RAW_ALL, """SELECT DISTINCT fecha_corte AS iso,
  fecha_corte AS dmy, CAST(date_trunc('month', fecha_corte) AS DATE) AS year_month FROM fact_rows"""))
def _date_parse(ctx):
    text = adapter.fund_rows_text(ctx.spark, ctx.sf_dir, None).select("fecha_corte")
    d = parse_iso_date(F.col("fecha_corte"))
    return text.select(
        d.alias("iso"),
        parse_dmy(F.date_format(d, "dd/MM/yyyy")).alias("dmy"),
        parse_year_month(F.date_format(d, "yyyy-MM")).alias("year_month")).distinct()


_DATES_SQL = O.panel_chain("y2") + ["days AS (SELECT DISTINCT fecha_corte AS d FROM panel)"]


def _days(ctx):
    return ctx.panel(2).select(F.col("fecha_corte").alias("d")).distinct()


register("date_floor_ceiling", O.with_ctes(_DATES_SQL, """SELECT d,
  CAST(date_trunc('year', d) AS DATE) AS floor_year, CAST(date_trunc('month', d) AS DATE) AS floor_month,
  CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE) AS ceiling_month FROM days"""))(
    lambda ctx: _days(ctx).select("d", floor_year(F.col("d")).alias("floor_year"),
                                  floor_month(F.col("d")).alias("floor_month"),
                                  ceiling_month(F.col("d")).alias("ceiling_month")))

register("date_shift", O.with_ctes(_DATES_SQL, """SELECT d,
  CAST(d - INTERVAL 1 YEAR AS DATE) AS minus_1y, CAST(d - INTERVAL 2 YEAR AS DATE) AS minus_2y,
  CAST(d - INTERVAL 1 MONTH AS DATE) AS minus_1m, CAST(d - INTERVAL 6 MONTH AS DATE) AS minus_6m FROM days"""))(
    lambda ctx: _days(ctx).select("d", shift_years(F.col("d"), -1).alias("minus_1y"),
                                  shift_years(F.col("d"), -2).alias("minus_2y"),
                                  shift_months(F.col("d"), -1).alias("minus_1m"),
                                  shift_months(F.col("d"), -6).alias("minus_6m")))


@register("weekday_flags", O.with_ctes(_DATES_SQL + [_FEST], """SELECT d, CAST(isodow(d) AS INTEGER) AS dia_semana,
  isodow(d) IN (6, 7) AS fin_de_semana,
  CAST(coalesce(h.festivo, FALSE) OR isodow(d) IN (6, 7) AS DOUBLE) AS dia_no_habil
  FROM days LEFT JOIN festivos h ON h.fecha = days.d"""))
def _weekday_flags(ctx):
    h = holidays(adapter.holiday_rows(ctx.spark, ctx.sf_dir))
    j = _days(ctx).join(h, F.col("d") == F.col("fecha"), "left")
    return j.select("d", weekday_mon1(F.col("d")).alias("dia_semana"),
                    is_weekend(F.col("d")).alias("fin_de_semana"),
                    (F.coalesce(F.col("festivo"), F.lit(False)) | is_weekend(F.col("d")))
                    .cast("double").alias("dia_no_habil"))


register("math_power_rate", O.with_ctes([O.PARAMS, O.lines("lines_o", "O"), O.report("rep", "lines_o")], sel(
    ["fecha_corte", "cod", "tipo_participacion", "factor_dia", "anual", "raiz", "magnitud", "redondeado"],
    f"""(SELECT *, sqrt(factor_dia) AS raiz, abs(factor_dia - 1) AS magnitud, {O.r('factor_dia', 5)} AS redondeado
  FROM (SELECT *, pow(factor_dia, 365.0) - 1 AS anual FROM rep) t0) t""")))(
    lambda ctx: ctx.report().select("fecha_corte", "cod", "tipo_participacion", "factor_dia",
                                    annualise(F.col("factor_dia"), 1).alias("anual"), F.sqrt("factor_dia").alias("raiz"),
                                    F.abs(F.col("factor_dia") - 1).alias("magnitud"), F.round("factor_dia", 5).alias("redondeado")))


@register("null_handling", O.with_ctes(FACTS2_REPORT_CHAIN[:5], sel(
    ["fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t",
     "crecimiento_dia"], f"""(SELECT fecha_corte, cod, tipo_participacion,
       {O.r('coalesce(rendimientos_abonados, 0.0)', 1)} AS rendimientos_abonados,
       {O.r('coalesce(precierre_fondo_dia_t, valor_fondo_cierre_dia_t)', 1)} AS precierre_fondo_dia_t
     FROM facts) t0, LATERAL (SELECT CASE WHEN precierre_fondo_dia_t - rendimientos_abonados = 0 THEN 0.0
       ELSE precierre_fondo_dia_t / (precierre_fondo_dia_t - rendimientos_abonados) - 1 END AS crecimiento_dia) t1""")))
def _null_handling(ctx):
    """NULL fill + zero-denominator guard on unpadded fact rows."""
    f = ctx.facts(2).fillna({"rendimientos_abonados": 0.0})
    f = f.withColumn("precierre_fondo_dia_t", F.coalesce("precierre_fondo_dia_t", "valor_fondo_cierre_dia_t"))
    return daily_growth(f).select("fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados",
                                  "precierre_fondo_dia_t", "crecimiento_dia")


def _fmt_sql(expr, digits):
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE format('{{:,.{digits}f}}', {expr}) END"


_FORMAT_SQL = O.with_ctes(O.dashboard_chain() + [f"""risk AS (
  SELECT *, {O.rent_sql('crecimiento_dia', 30)} AS rent_30, {O.rent_sql('crecimiento_dia', 365)} AS rent_365,
         {O.vol_sql('crecimiento_dia', 30)} AS vol_30, {O.vol_sql('crecimiento_dia', 365)} AS vol_365
  FROM dash_facts)""", f"""s AS (
  SELECT d.nombre_entidad, d.nombre_patrimonio AS fondo, r.tipo_participacion AS participacion,
         r.rent_30, r.rent_365, r.vol_30, r.vol_365, r.valor_fondo_cierre_dia_t AS valor_cierre,
         r.rendimientos_abonados AS rendimientos, r.transaccciones_netas AS valor_transacciones,
         r.numero_inversionistas AS inversionistas, r.numero_unidades_fondo_cierre AS unidades,
         {O.r('r.valor_unidad_operaciones', 2)} AS valor_unidad
  FROM risk r LEFT JOIN dash_dims d ON d.cod = r.cod
  WHERE r.fecha_corte = (SELECT max(fecha_corte) FROM dash_facts))"""],
    "SELECT " + ", ".join([
        "CASE WHEN length(nombre_entidad) > 20 THEN substring(nombre_entidad, 1, 20) || '…' "
        "ELSE nombre_entidad END AS nombre_entidad",
        "CASE WHEN length(fondo) > 30 THEN substring(fondo, 1, 30) || '…' ELSE fondo END AS fondo",
        "participacion",
        *[f"{_fmt_sql(c + ' * 100', 2)} || '%' AS {c}" for c in ("rent_30", "rent_365", "vol_30", "vol_365")],
        *[f"'$' || {_fmt_sql('floor(' + c + ' / 1e6)', 0)} || 'M' AS {c}"
          for c in ("valor_cierre", "rendimientos", "valor_transacciones")],
        f"{_fmt_sql('inversionistas', 0)} AS inversionistas",
        f"{_fmt_sql('unidades', 2)} AS unidades",
        f"'$' || {_fmt_sql('valor_unidad', 2)} AS valor_unidad",
    ]) + " FROM s")


@register("format_display", _FORMAT_SQL)
def _format_display(ctx):
    facts, dims = ctx.dashboard()
    return format_display(summary_table(facts, dims, 30, 365))
