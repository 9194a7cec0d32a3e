"""Registered queries: universe screens, aggregations, window operators,
reports, diagnostics, forecast data preparation and evaluation
(SURVEY 2.4, 2.6, 2.7, 2.11, 2.12, 2.13 M1-M5/M10/M11, 2.14)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from fundlens.functions.dates import py_add_months
from fundlens.operators import forecast as FC
from fundlens.operators import stats as ST
from fundlens.operators.cluster import co_association
from fundlens.operators.joins import align_prediction, semi
from fundlens.operators.panel import CARRY, SERIES, accrue_from_rate, daily_growth, fill_flows, merge_sources, pad_daily
from fundlens.operators.rolling import rolling, rolling_return_ann, rolling_return_gross, rolling_vol_ann
from fundlens.operators.universe import (active_series, base_share_class, cluster_peers, filter_exclude_period,
                                         filter_latest_date, long_series, moving_funds, representative_fund)
from fundlens.plans import oracle as O
from fundlens.plans.queries_core import SUMMARY_CTES
from fundlens.plans.queries_ops import _DASH_DIM_SQL, _FEST, _IPC, _TRM, NUM, PANEL, SHOCK, sel
from fundlens.plans.catalog import register
from fundlens.plans.report import (forecast_projection, forecast_report, rename_all, return_curves,
                                   summary_table)
from fundlens.sources import adapter

NUM.update({"rent_brut_30", "q1", "q2", "q3", "mean_creci", "acf", "ccf", "observed", "trend", "season",
            "remainder", "value", "min", "max", "q25", "median", "q75", "mediana", "mediana_emp",
            "cercania", "conf_lo", "conf_hi", "dia_no_habil", "rmse", "coverage_90", "coverage_50",
            "age", "observed_flag", "creci_dia_filled", "scale", "creci_dia_scaled", "q05", "q95",
            "crecimiento_dia_max_30", "crecimiento_dia_avg_30", "std", "rent", "co_association"} | {f"d_{i}" for i in range(731)})


def _macro(ctx):
    return (adapter.trm_rows(ctx.spark, ctx.sf_dir), adapter.ipc_rows(ctx.spark, ctx.sf_dir),
            adapter.holiday_rows(ctx.spark, ctx.sf_dir))


# ============================== 2.4 universe screens ==============================

P2 = O.panel_chain("y2")
register("active_series", O.with_ctes(P2, sel(PANEL, "panel", """WHERE (cod, tipo_participacion) IN (
  SELECT cod, tipo_participacion FROM panel GROUP BY ALL HAVING max(fecha_corte) = (SELECT max(fecha_corte) FROM panel))""")))(
    lambda ctx: active_series(ctx.panel(2)))
register("long_series", O.with_ctes(P2, sel(PANEL, "panel", """WHERE (cod, tipo_participacion) IN (
  SELECT cod, tipo_participacion FROM panel GROUP BY ALL HAVING count(*) > 365)""")))(
    lambda ctx: long_series(ctx.panel(2), 365))
register("base_share_class", O.with_ctes(P2 + [O.base_share("b2", "panel")], sel(PANEL, "b2")))(
    lambda ctx: base_share_class(ctx.panel(2)))
register("dashboard_universe", O.with_ctes(O.dashboard_chain(), sel(PANEL, "dash_facts")))(
    lambda ctx: rename_all(ctx.dashboard()[0], PANEL))
register("base_universe", O.with_ctes(O.base5_chain(), sel(PANEL, "base5")))(lambda ctx: ctx.base5())

MOVING_CTES = O.base5_chain() + ["""rec AS (SELECT base5.* FROM base5, params WHERE fecha_corte >= params.y1)""",
                                 """mst AS (SELECT cod, count(*) AS n,
  count(*) FILTER (WHERE transaccciones_netas <> 0) AS mov, count(transaccciones_netas) AS fn
  FROM rec GROUP BY cod)""", """mkeep AS (SELECT cod, n FROM mst WHERE fn = n AND mov / n >= 0.05)""",
                                 """moving AS (SELECT fecha_corte, cod, crecimiento_dia FROM rec
  WHERE cod IN (SELECT cod FROM mkeep WHERE n = (SELECT max(n) FROM mkeep)) AND crecimiento_dia IS NOT NULL)"""]
MIN_SHARE = 0.05  # about 8 % of the stand-in days carry flows; 0.5 would leave nothing


def _moving(ctx):
    return moving_funds(ctx.base5(), ctx.years_back(1), MIN_SHARE)


register("moving_funds", O.with_ctes(MOVING_CTES, sel(["fecha_corte", "cod", "crecimiento_dia"], "moving")))(
    _moving)

REP_CTES = MOVING_CTES + O.dims_chain() + [f"""rv AS (
  SELECT *, {O.rent_sql('crecimiento_dia', 30)} AS rent_30 FROM base5 WHERE cod IN (SELECT cod FROM moving))""",
    """rec7 AS (SELECT r.cod, r.rent_30, d.nombre_entidad FROM rv r CROSS JOIN params p
  LEFT JOIN dims d ON d.cod = r.cod WHERE r.fecha_corte >= p.y1)""", """pf AS (
  SELECT nombre_entidad, cod,
         CASE WHEN count(*) FILTER (WHERE rent_30 IS NULL) = 0 THEN median(rent_30) END AS mediana
  FROM rec7 GROUP BY ALL)""", """ent AS (
  SELECT *, CASE WHEN count(*) FILTER (WHERE mediana IS NULL) OVER (PARTITION BY nombre_entidad) = 0
                 THEN median(mediana) OVER (PARTITION BY nombre_entidad) END AS mediana_emp FROM pf)"""]


def _rep_input(ctx):
    base = semi(ctx.base5(), _moving(ctx), "cod")
    rv = rolling_return_ann(base, 30, sk=SERIES)
    rv = rv.where(F.col("fecha_corte") >= F.lit(ctx.years_back(1)))
    return rv.join(ctx.dims(2).select("cod", "nombre_entidad"), "cod", "left")


register("representative_fund", O.with_ctes(REP_CTES + ["""ent2 AS (
  SELECT *, abs(mediana - mediana_emp) AS cercania FROM ent)""", """c1 AS (
  SELECT * FROM (SELECT *, min(cercania) OVER (PARTITION BY nombre_entidad) AS mc FROM ent2) t
  WHERE cercania = mc)""", """c2 AS (
  SELECT * FROM (SELECT *, max(mediana) OVER (PARTITION BY nombre_entidad) AS mm FROM c1) t WHERE mediana = mm)"""],
    sel(["nombre_entidad", "cod", "mediana", "mediana_emp", "cercania"], "c2")))(
    lambda ctx: representative_fund(_rep_input(ctx), "rent_30"))

LABEL_CTES = O.base5_chain() + ["""labels AS (
  SELECT DISTINCT cod, CAST(split_part(cod, '_', 4) AS INTEGER) % 5 AS cluster FROM base5)""",
    """peers AS (SELECT * FROM labels WHERE cluster = (SELECT cluster FROM labels WHERE cod = (SELECT min(cod) FROM labels)))"""]


def _labels(ctx):
    """Stand-in cluster labels (``codigo_negocio % 5``) of the base funds."""
    return ctx.base5().select("cod").distinct().withColumn(
        "cluster", F.split("cod", "_").getItem(3).cast("int") % 5)


def _first_code(df):
    return df.agg(F.min("cod")).first()[0]


@register("co_association", O.with_ctes(LABEL_CTES + ["""runs AS (
  SELECT cod, run, CAST(split_part(cod, '_', 4) AS INTEGER) % run AS label FROM labels CROSS JOIN range(2, 10) t(run))"""],
    """SELECT b.cod, avg(CAST(a.label = b.label AS DOUBLE)) AS co_association, count(*) AS runs
  FROM runs a JOIN runs b ON a.run = b.run AND a.cod <> b.cod WHERE a.cod = (SELECT min(cod) FROM labels) GROUP BY b.cod"""))
def _co_association(ctx):
    """Co-association of the first base fund with every other, on eight stand-in runs (``codigo_negocio % run``)."""
    code = F.split("cod", "_").getItem(3).cast("int")
    each = ctx.base5().select("cod").distinct().select("cod", F.explode(F.sequence(F.lit(2), F.lit(9))).alias("_r"))
    runs = each.select("cod", F.col("_r").cast("string").alias("run"), (code % F.col("_r")).alias("label"))
    return co_association(runs, _first_code(runs))


register("cluster_peers", O.with_ctes(LABEL_CTES, "SELECT cod, cluster FROM peers"))(
    lambda ctx: cluster_peers(_labels(ctx), _first_code(_labels(ctx))))


@register("exclude_codes", O.with_ctes(LABEL_CTES, "SELECT cod, cluster FROM peers WHERE cod <> (SELECT max(cod) FROM peers)"))
def _exclude_codes(ctx):
    labels = _labels(ctx)
    peers = cluster_peers(labels, _first_code(labels))
    drop = peers.agg(F.max("cod")).first()[0]
    return cluster_peers(labels, _first_code(labels), exclude=[drop])


register("frequency_table", O.with_ctes(LABEL_CTES, "SELECT cluster, count(*) AS n FROM labels GROUP BY cluster"))(
    lambda ctx: _labels(ctx).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))


# ============================== 2.6 aggregations ==============================

register("count_by_series", O.with_ctes(P2, "SELECT cod, tipo_participacion, count(*) AS n FROM panel GROUP BY ALL"))(
    lambda ctx: ctx.panel(2).groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")))

register("max_date_by_series", O.with_ctes(P2, """SELECT cod, tipo_participacion, max(fecha_corte) AS max_fecha,
  (SELECT max(fecha_corte) FROM panel) AS max_global FROM panel GROUP BY ALL"""))(
    lambda ctx: (lambda per: per.withColumn("max_global", per.agg(F.max("max_fecha")).scalar()))(
        ctx.panel(2).groupBy(*SERIES).agg(F.max("fecha_corte").alias("max_fecha"))))

IDX_CTES = O.base5_chain() + ["""idx AS (SELECT fecha_corte, quantile_cont(crecimiento_dia, 0.5) AS mean_creci
  FROM base5 GROUP BY fecha_corte)"""]


def _index(ctx):
    """The daily index, written once: one row per day, read several times by each diagnostic."""
    return ctx._cached(("index",), lambda: ST.cross_section_median(ctx.base5()).checkpoint(eager=True))


register("cross_section_median", O.with_ctes(IDX_CTES, sel(["fecha_corte", "mean_creci"], "idx")))(_index)

BAND_CTES = LABEL_CTES + [f"""brut AS (
  SELECT b.*, {O.gross_sql('crecimiento_dia', 30)} AS rent_brut_30
  FROM (SELECT base5.* FROM base5, params WHERE fecha_corte >= params.y1) b)"""]
register("quantile_band", O.with_ctes(BAND_CTES, sel(["cluster", "fecha_corte", "q1", "q2", "q3"], """(
  SELECT l.cluster, b.fecha_corte, quantile_cont(b.rent_brut_30, 0.25) AS q1,
         quantile_cont(b.rent_brut_30, 0.5) AS q2, quantile_cont(b.rent_brut_30, 0.75) AS q3
  FROM brut b JOIN labels l USING (cod) WHERE b.rent_brut_30 IS NOT NULL GROUP BY ALL) t""")))(
    lambda ctx: ST.quantile_band(
        rolling_return_gross(ctx.base5().where(F.col("fecha_corte") >= F.lit(ctx.years_back(1))), 30)
        .join(_labels(ctx), "cod").dropna(subset=["rent_brut_30"]),
        ["cluster", "fecha_corte"], "rent_brut_30"))

register("grouped_min_median", O.with_ctes(REP_CTES, sel(["nombre_entidad", "cod", "mediana", "mediana_emp"], "ent")))(
    lambda ctx: ST.grouped_min_median(_rep_input(ctx), "nombre_entidad", "cod", "rent_30"))


# ============================== model dataset, holdout, naive forecasts ==============================

DS_CTES = O.base5_chain() + [_TRM, _IPC, _FEST, """mb AS (SELECT cod, fecha_corte, crecimiento_dia AS creci_dia FROM base5)""",
    """fut0 AS (SELECT cod, max(fecha_corte) AS last FROM mb GROUP BY cod)""",
    """fut AS (SELECT cod, last + CAST(unnest(range(1, 29)) AS INTEGER) AS fecha_corte FROM fut0)""",
    """ext AS (SELECT cod, fecha_corte, creci_dia FROM mb UNION ALL SELECT cod, fecha_corte, NULL FROM fut)""",
    """mj AS (SELECT e.*, t.trm, i.ipc, coalesce(h.festivo, FALSE) AS festivo FROM ext e
  LEFT JOIN trm t ON t.fecha = e.fecha_corte LEFT JOIN ipc i ON i.fecha = e.fecha_corte
  LEFT JOIN festivos h ON h.fecha = e.fecha_corte)""", """mc AS (
  SELECT cod, fecha_corte, creci_dia,
         last_value(trm IGNORE NULLS) OVER w AS trm, last_value(ipc IGNORE NULLS) OVER w AS ipc,
         CAST(festivo OR isodow(fecha_corte) IN (6, 7) AS DOUBLE) AS dia_no_habil
  FROM mj WINDOW w AS (PARTITION BY cod ORDER BY fecha_corte ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    """ds AS (SELECT cod, fecha_corte, creci_dia,
  (trm - avg(trm) OVER ()) / stddev_samp(trm) OVER () AS trm,
  (ipc - avg(ipc) OVER ()) / stddev_samp(ipc) OVER () AS ipc, dia_no_habil FROM mc)""",
    """model_rows AS (SELECT * FROM ds WHERE creci_dia IS NOT NULL)""",
    """cut AS (SELECT min(fecha_corte) AS c FROM (SELECT DISTINCT fecha_corte FROM model_rows
  ORDER BY fecha_corte DESC LIMIT 28) t)""",
    """test AS (SELECT * FROM model_rows WHERE fecha_corte >= (SELECT c FROM cut))""",
    """naive7 AS (SELECT t.cod, t.fecha_corte, a.creci_dia AS mean FROM test t, cut
  JOIN model_rows a ON a.cod = t.cod AND a.fecha_corte = cut.c + CAST((t.fecha_corte - cut.c) % 7 - 7 AS INTEGER))""",
    """naive1 AS (SELECT t.cod, t.fecha_corte, a.creci_dia AS mean FROM test t, cut
  JOIN model_rows a ON a.cod = t.cod AND a.fecha_corte = cut.c - 1)""",
    """origins AS (SELECT CAST(cut.c - CAST(28 * k AS INTEGER) AS DATE) AS o FROM cut, range(1, 14) t(k))""",
    """nres AS (SELECT t.creci_dia - a.creci_dia AS r FROM model_rows t
  JOIN origins ON t.fecha_corte >= o AND t.fecha_corte < o + 28
  JOIN model_rows a ON a.cod = t.cod AND a.fecha_corte = o + CAST((t.fecha_corte - o) % 7 - 7 AS INTEGER))""",
    """band AS (SELECT quantile_cont(r, 0.05) AS b05, quantile_cont(r, 0.25) AS b25,
  quantile_cont(r, 0.75) AS b75, quantile_cont(r, 0.95) AS b95 FROM nres)""",
    """mlast AS (SELECT cod, max(fecha_corte) AS last FROM model_rows GROUP BY cod)""",
    """fc AS (SELECT f.cod, f.fecha_corte, a.creci_dia AS mean, a.creci_dia + (SELECT b25 FROM band) AS q25, a.creci_dia + (SELECT b75 FROM band) AS q75
  FROM (SELECT cod, last, last + CAST(unnest(range(1, 29)) AS INTEGER) AS fecha_corte FROM mlast) f
  LEFT JOIN model_rows a ON a.cod = f.cod
   AND a.fecha_corte = f.last + CAST((datediff('day', f.last, f.fecha_corte) - 1) % 7 - 6 AS INTEGER))"""]
DS_COLS = ["cod", "fecha_corte", "creci_dia", "trm", "ipc", "dia_no_habil"]


def _ds(ctx):
    """The model dataset, its rows stored once by fund."""
    return ctx._cached(("ds",), lambda: FC.model_dataset(
        ctx.base5(), *_macro(ctx), partitions=ctx.buckets(), write=lambda rows: ctx.bucketed(rows, "ds", ["cod"])))


def _model_rows(ctx):
    return FC.null_split(_ds(ctx))[1]


def _test_start(ctx):
    """First day of the last 28 distinct days."""
    return ctx._cached(("test_start",), lambda: _model_rows(ctx).select("fecha_corte").distinct().orderBy(
        F.col("fecha_corte").desc()).limit(28).agg(F.min("fecha_corte")).first()[0])


def _test(ctx):
    """The rows of the test window."""
    return _model_rows(ctx).where(F.col("fecha_corte") >= F.lit(_test_start(ctx)))


def _naive(ctx, lag):
    rows = _model_rows(ctx)
    return FC.seasonal_naive(rows, _test_start(ctx), horizon=28, lag=lag)


def _naive_residuals(ctx):
    """Errors of the weekly control on thirteen windows before the test window, as in the source."""
    return ctx._cached(("naive_residuals",), lambda: FC.naive_residuals(
        _model_rows(ctx), _test_start(ctx), folds=13).checkpoint(eager=True))


def _future(ctx):
    return FC.residual_bands(FC.seasonal_naive_future(_model_rows(ctx)), _naive_residuals(ctx))


register("model_dataset", O.with_ctes(DS_CTES, sel(DS_COLS, "ds")))(_ds)
register("null_split", O.with_ctes(DS_CTES, sel(DS_COLS + ["split"], """(SELECT *,
  CASE WHEN creci_dia IS NULL THEN 'future' ELSE 'model' END AS split FROM ds) t""")))(
    lambda ctx: (lambda parts: parts[0].withColumn("split", F.lit("future")).unionByName(
        parts[1].withColumn("split", F.lit("model"))))(FC.null_split(_ds(ctx))))
register("quality_nulls", O.with_ctes(DS_CTES, "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}" for c in DS_COLS) + ", " + "greatest(" + ", ".join(
    f"count(*) FILTER (WHERE {c} IS NULL)" for c in DS_COLS) + ") > 0 AS any_null FROM ds"))(
    lambda ctx: FC.quality_nulls(_ds(ctx)))
register("extend_future", O.with_ctes(DS_CTES, sel(["cod", "fecha_corte", "creci_dia"], "ext")))(
    lambda ctx: FC.extend_future(ctx.base5().select("cod", "fecha_corte", F.col("crecimiento_dia").alias("creci_dia"))))


@register("holdout_split", O.with_ctes(DS_CTES, sel(DS_COLS + ["split"], """(SELECT *,
  CASE WHEN fecha_corte >= (SELECT c FROM cut) THEN 'test' ELSE 'train' END AS split FROM model_rows) t""")))
def _holdout_split(ctx):
    train, test = FC.holdout_split(_model_rows(ctx), 28)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


CV_CTES = IDX_CTES + ["""cvx AS (SELECT fecha_corte FROM idx, params
  WHERE fecha_corte >= CAST(params.as_of - INTERVAL 2 YEAR AS DATE))""",
    """folds AS (SELECT CAST(f AS INTEGER) AS fold,
  (SELECT max(fecha_corte) FROM cvx) - CAST((f - 1) * 28 AS INTEGER) AS a_end,
  (SELECT max(fecha_corte) FROM cvx) - CAST((f - 1) * 28 + 27 AS INTEGER) AS a_start
  FROM range(1, 14) t(f))""", """plan AS (
  SELECT fo.fold, x.fecha_corte, CASE WHEN x.fecha_corte >= fo.a_start THEN 'assessment' ELSE 'analysis' END AS role
  FROM cvx x JOIN folds fo ON x.fecha_corte <= fo.a_end
  WHERE fo.a_start > (SELECT min(fecha_corte) FROM cvx))"""]
register("cv_plan", O.with_ctes(CV_CTES, "SELECT fold, fecha_corte, role FROM plan"))(
    lambda ctx: FC.cv_plan(_index(ctx).where(F.col("fecha_corte") >= F.lit(py_add_months(ctx.as_of, -24))),
                           key=None))

register("align_prediction", O.with_ctes(DS_CTES, sel(["cod", "fecha_corte", "mean", "actual"], """(
  SELECT n.cod, n.fecha_corte, n.mean, t.creci_dia AS actual FROM naive7 n JOIN test t USING (cod, fecha_corte)) t""")))(
    lambda ctx: align_prediction(_naive(ctx, 7), _test(ctx)))
register("rmse", O.with_ctes(DS_CTES, sel(["rmse", "n"], """(SELECT sqrt(avg(pow(n.mean - t.creci_dia, 2))) AS rmse,
  count(*) AS n FROM naive7 n JOIN test t USING (cod, fecha_corte)) t""")))(
    lambda ctx: FC.rmse(_naive(ctx, 7), _test(ctx)))


@register("leaderboard", O.with_ctes(DS_CTES, sel(["model", "rmse", "n", "rank"], """(
  SELECT *, CAST(rank() OVER (ORDER BY rmse, model) AS INTEGER) AS rank FROM (
    SELECT model, sqrt(avg(pow(p.mean - t.creci_dia, 2))) AS rmse, count(*) AS n
    FROM (SELECT 'naive_7' AS model, * FROM naive7 UNION ALL SELECT 'naive_1', * FROM naive1) p
    JOIN test t USING (cod, fecha_corte) GROUP BY model) s) t""")))
def _leaderboard(ctx):
    preds = _naive(ctx, 7).withColumn("model", F.lit("naive_7")).unionByName(
        _naive(ctx, 1).withColumn("model", F.lit("naive_1")))
    return FC.leaderboard(preds, _test(ctx)).select("model", "rmse", "n", "rank")


register("holdout_eval", O.with_ctes(DS_CTES, sel(["rmse", "coverage_90", "coverage_50", "n"], """(
  SELECT sqrt(avg(pow(n.mean - t.creci_dia, 2))) AS rmse,
         avg(CAST(t.creci_dia BETWEEN n.mean + b05 AND n.mean + b95 AS DOUBLE)) AS coverage_90,
         avg(CAST(t.creci_dia BETWEEN n.mean + b25 AND n.mean + b75 AS DOUBLE)) AS coverage_50,
         count(*) AS n FROM naive7 n JOIN test t USING (cod, fecha_corte), band) t""")))(
    lambda ctx: FC.holdout_eval(FC.residual_bands(_naive(ctx, 7), _naive_residuals(ctx)), _test(ctx)))

REPORT_COLS = ["cod", "model_id", "model_desc", "key", "fecha", "value", "conf_lo", "conf_hi", "dia_no_habil"]
REPORT_CTES = DS_CTES + ["""frep AS (
  SELECT cod, CAST(NULL AS INTEGER) AS model_id, 'ACTUAL' AS model_desc, 'actual' AS key, fecha_corte AS fecha,
         creci_dia AS value, CAST(NULL AS DOUBLE) AS conf_lo, CAST(NULL AS DOUBLE) AS conf_hi, dia_no_habil
  FROM model_rows
  UNION ALL
  SELECT cod, CASE WHEN q25 IS NULL THEN NULL ELSE 1 END,
         CASE WHEN q25 IS NULL THEN 'ACTUAL' ELSE 'SPARK_TS' END,
         CASE WHEN q25 IS NULL THEN 'actual' ELSE 'prediction' END,
         fecha_corte, mean, q25, q75, CAST(NULL AS DOUBLE) FROM fc)"""]


def _report(ctx):
    return forecast_report(_model_rows(ctx), _future(ctx))


def _report_by_fund(ctx):
    """The report in partitions by fund that hold no more rows than a bucket, for what rolls over it."""
    return _report(ctx).repartition(ctx.buckets(), "cod")


register("union_forecast", O.with_ctes(REPORT_CTES, sel(
    ["cod", "fecha_corte", "creci_dia", "dia_no_habil", "q25", "q75"], """(
  SELECT cod, fecha_corte, creci_dia, dia_no_habil, CAST(NULL AS DOUBLE) AS q25, CAST(NULL AS DOUBLE) AS q75
  FROM model_rows UNION ALL SELECT cod, fecha_corte, mean, NULL, q25, q75 FROM fc) t""")))(
    lambda ctx: _model_rows(ctx).select("cod", "fecha_corte", "creci_dia", "dia_no_habil").unionByName(
        _future(ctx).select("cod", "fecha_corte", F.col("mean").alias("creci_dia"), "q25", "q75"),
        allowMissingColumns=True))
register("forecast_report", O.with_ctes(REPORT_CTES, sel(REPORT_COLS, "frep")))(_report)

PROJ_SQL = O.with_ctes(REPORT_CTES + [f"""fproj AS (
  SELECT cod, model_id, model_desc, key, fecha, dia_no_habil,
         {O.rent_sql('value', 30, 'cod', 'fecha')} AS value,
         {O.rent_sql('coalesce(conf_lo, value)', 30, 'cod', 'fecha')} AS conf_lo,
         {O.rent_sql('coalesce(conf_hi, value)', 30, 'cod', 'fecha')} AS conf_hi
  FROM frep)"""], sel(REPORT_COLS, "fproj, params", "WHERE fecha >= CAST(params.as_of - INTERVAL 12 MONTH AS DATE)"))
register("forecast_projection", PROJ_SQL)(lambda ctx: forecast_projection(_report_by_fund(ctx), ctx.as_of, 30, 12))
register("rolling_generic", O.with_ctes(REPORT_CTES + [f"""fproj AS (
  SELECT cod, model_id, model_desc, key, fecha, dia_no_habil,
         {O.rent_sql('value', 30, 'cod', 'fecha')} AS value,
         {O.rent_sql('coalesce(conf_lo, value)', 30, 'cod', 'fecha')} AS conf_lo,
         {O.rent_sql('coalesce(conf_hi, value)', 30, 'cod', 'fecha')} AS conf_hi
  FROM frep)"""], sel(REPORT_COLS, "fproj")))(
    lambda ctx: __import__("fundlens.operators.rolling", fromlist=["rolling_generic"]).rolling_generic(
        _report_by_fund(ctx), ["value", "conf_lo", "conf_hi"], 30, value_col="value", sk=("cod",), dc="fecha"))


# ============================== 2.7 windows ==============================

P2_PARTS = O.panel_chain("y2")[:-1] + [O.panel("panel", "merged")]
VALS = ["rendimientos_abonados", "precierre_fondo_dia_t", "numero_unidades_fondo_cierre",
        "valor_unidad_operaciones", "valor_fondo_cierre_dia_t", "numero_inversionistas", "transaccciones_netas"]
MERGED_ORDER = ["fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t",
                "valor_fondo_cierre_dia_t", "numero_unidades_fondo_cierre", "valor_unidad_operaciones",
                "numero_inversionistas", "transaccciones_netas"]


def _merged(ctx):
    return merge_sources(ctx.facts(2), ctx.report(), ctx.as_of)


register("lag_accrual", O.with_ctes(O.panel_chain("y2")[:7], sel(
    ["fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t",
     "valor_fondo_cierre_dia_t", "numero_inversionistas", "numero_unidades_fondo_cierre",
     "valor_unidad_operaciones"], "rep_acc")))(lambda ctx: accrue_from_rate(ctx.report()))
register("pad_daily", O.with_ctes(P2_PARTS, sel(["fecha_corte", "cod", "tipo_participacion"] + VALS, "panel_pad")))(
    lambda ctx: pad_daily(_merged(ctx), fill_carry=False))
_LOCF_SQL = ("SELECT fecha_corte, cod, tipo_participacion, rendimientos_abonados, precierre_fondo_dia_t, " +
             ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY cod, tipo_participacion ORDER BY fecha_corte "
                       f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in CARRY) +
             ", transaccciones_netas FROM panel_pad")
register("locf", O.with_ctes(P2_PARTS + [f"lc AS ({_LOCF_SQL})"], sel(["fecha_corte", "cod", "tipo_participacion"] + VALS, "lc")))(
    lambda ctx: pad_daily(_merged(ctx)))
register("fill_flows", O.with_ctes(P2_PARTS, sel(["fecha_corte", "cod", "tipo_participacion"] + VALS, "panel_fill")))(
    lambda ctx: fill_flows(pad_daily(_merged(ctx))))
register("daily_growth", O.with_ctes(O.panel_chain("y2")[:5], sel(
    ["fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados", "precierre_fondo_dia_t", "crecimiento_dia"],
    f"""(SELECT fecha_corte, cod, tipo_participacion, {O.r('rendimientos_abonados', 1)} AS rendimientos_abonados,
          {O.r('precierre_fondo_dia_t', 1)} AS precierre_fondo_dia_t FROM facts) t0,
        LATERAL (SELECT CASE WHEN precierre_fondo_dia_t - rendimientos_abonados = 0 THEN 0.0
          ELSE precierre_fondo_dia_t / (precierre_fondo_dia_t - rendimientos_abonados) - 1 END AS crecimiento_dia) t1""")))(
    lambda ctx: daily_growth(ctx.facts(2)).select("fecha_corte", "cod", "tipo_participacion", "rendimientos_abonados",
                                                  "precierre_fondo_dia_t", "crecimiento_dia"))

_K = ["fecha_corte", "cod", "tipo_participacion", "crecimiento_dia"]
register("rolling_return_ann", O.with_ctes(P2, sel(_K + ["rent_30"], f"(SELECT *, {O.rent_sql('crecimiento_dia', 30)} AS rent_30 FROM panel) t")))(
    lambda ctx: rolling_return_ann(ctx.panel(2).select(*_K), 30))
register("rolling_vol_ann", O.with_ctes(P2, sel(_K + ["vol_365"], f"(SELECT *, {O.vol_sql('crecimiento_dia', 365)} AS vol_365 FROM panel) t")))(
    lambda ctx: rolling_vol_ann(ctx.panel(2).select(*_K), 365))
register("rolling_return_gross", O.with_ctes(P2, sel(_K + ["rent_brut_30"], f"(SELECT *, {O.gross_sql('crecimiento_dia', 30)} AS rent_brut_30 FROM panel) t")))(
    lambda ctx: rolling_return_gross(ctx.panel(2).select(*_K), 30))

_GS = ["max_fecha", "n", "mov", "mediana"]
register("group_stat_over", O.with_ctes(P2, sel(_K + _GS, """(SELECT fecha_corte, cod, tipo_participacion, crecimiento_dia,
  max(fecha_corte) OVER w AS max_fecha, count(*) OVER w AS n,
  CAST(sum(CASE WHEN transaccciones_netas <> 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS mov,
  median(crecimiento_dia) OVER w AS mediana FROM panel WINDOW w AS (PARTITION BY cod, tipo_participacion)) t""")))(
    lambda ctx: ST.group_stat_over(ctx.panel(2).select(*_K, "transaccciones_netas"), SERIES, {
        "max_fecha": F.max("fecha_corte"), "n": F.count(F.lit(1)),
        "mov": F.sum(F.when(F.col("transaccciones_netas") != 0, 1).otherwise(0)),
        "mediana": F.percentile("crecimiento_dia", 0.5)}).drop("transaccciones_netas"))

register("standardize", O.with_ctes(MOVING_CTES, sel(["fecha_corte", "cod", "crecimiento_dia"], """(
  SELECT fecha_corte, cod, (crecimiento_dia - avg(crecimiento_dia) OVER ()) / stddev_samp(crecimiento_dia) OVER ()
         AS crecimiento_dia FROM moving) t""")))(lambda ctx: FC.standardize(_moving(ctx), ["crecimiento_dia"]))

register("rolling_udf", O.with_ctes(P2, sel(_K + ["crecimiento_dia_max_30", "crecimiento_dia_avg_30"], f"""(SELECT *,
  CASE WHEN count(crecimiento_dia) OVER ({O.frame(30)}) = 30 THEN max(crecimiento_dia) OVER ({O.frame(30)}) END AS crecimiento_dia_max_30,
  CASE WHEN count(crecimiento_dia) OVER ({O.frame(30)}) = 30 THEN avg(crecimiento_dia) OVER ({O.frame(30)}) END AS crecimiento_dia_avg_30
  FROM panel) t""")))(
    lambda ctx: rolling(rolling(ctx.panel(2).select(*_K), "crecimiento_dia", 30, F.max, "crecimiento_dia_max_30"),
                        "crecimiento_dia", 30, F.avg, "crecimiento_dia_avg_30"))


TRIMS = (0.0, 0.1, 0.25)


def _trimmed_mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """A user's function for one parameter row and fund: mean growth without
    the ``trim`` share of lowest and of highest days."""
    g = pdf["crecimiento_dia"].dropna().sort_values()
    cut = int(len(g) * pdf["trim"].iloc[0])
    kept = g.iloc[cut:len(g) - cut]
    return pd.DataFrame({"cod": [pdf["cod"].iloc[0]], "trim": [pdf["trim"].iloc[0]], "n": [len(kept)],
                         "trimmed_mean": [kept.mean() if len(kept) else None]})


def per_parameter(df, grid, fn, schema: str, keys=("cod",)):
    """Apply a user's pandas function once per group and parameter row.

    ``grid`` maps a column name to its values; the rows are replicated per
    parameter row, and a group is one (keys, parameters) combination."""
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.groupBy(*keys, *grid).applyInPandas(fn, schema)


NUM.update({"trim", "trimmed_mean"})
register("grouped_map", O.with_ctes(O.base5_chain(), sel(["cod", "trim", "n", "trimmed_mean"], """(
  SELECT cod, trim, count(*) AS n, avg(crecimiento_dia) AS trimmed_mean FROM (
    SELECT cod, crecimiento_dia, row_number() OVER w AS pos, count(*) OVER (PARTITION BY cod) AS total
    FROM base5 WHERE crecimiento_dia IS NOT NULL WINDOW w AS (PARTITION BY cod ORDER BY crecimiento_dia)) s
  CROSS JOIN (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE)) v(trim)
  WHERE pos > floor(total * trim) AND pos <= total - floor(total * trim) GROUP BY cod, trim) t""")))(
    lambda ctx: per_parameter(ctx.base5().select("cod", "crecimiento_dia"), {"trim": TRIMS}, _trimmed_mean,
                              "cod string, trim double, n long, trimmed_mean double"))


# ============================== 2.11 reshape and report ==============================

#: Days of the pivot's window: from 1 January of the year before last to the end of a second year, a leap day included.
PIVOT_DAYS = 731


@register("pivot_wide", O.with_ctes(O.base5_chain() + ["""lastw AS (SELECT cod, crecimiento_dia,
  datediff('day', params.y1, fecha_corte) AS k FROM base5, params WHERE fecha_corte >= params.y1)"""],
    "SELECT cod, " + ", ".join(f"{O.r8(f'max(CASE WHEN k = {i} THEN crecimiento_dia END)')} AS d_{i}"
                               for i in range(PIVOT_DAYS)) + " FROM lastw GROUP BY cod"))
def _pivot_wide(ctx):
    """Daily growth of the base funds, one column per calendar day since 1 January of the year before ``as_of``."""
    since = ctx.years_back(1)
    rows = ctx.base5().where(F.col("fecha_corte") >= F.lit(since))
    return ST.pivot_days(rows, "cod", "crecimiento_dia", since, PIVOT_DAYS)


_IDS = ["nombre_entidad", "fondo", "participacion"]
register("unpivot_long", O.with_ctes(SUMMARY_CTES, " UNION ALL ".join(
    f"SELECT nombre_entidad, fondo, participacion, '{c}' AS name, {O.r8(c)} AS value FROM summary"
    for c in ("rent_30", "rent_365", "vol_30", "vol_365"))))(
    lambda ctx: ST.unpivot_long(summary_table(*ctx.dashboard(), 30, 365), _IDS,
                                ["rent_30", "rent_365", "vol_30", "vol_365"]))

register("clean_dims", O.with_ctes([O.PARAMS] + O.dims_chain(), "SELECT * FROM dims"))(lambda ctx: ctx.dims(2))
register("dashboard_tables", O.with_ctes(O.dashboard_chain(), f"SELECT {_DASH_DIM_SQL} FROM dash_dims"))(
    lambda ctx: ctx.dashboard()[1])
register("cutoff_date", O.with_ctes(O.dashboard_chain(), "SELECT max(fecha_corte) AS fecha_corte FROM dash_facts"))(
    lambda ctx: __import__("fundlens.plans.report", fromlist=["cutoff_date"]).cutoff_date(ctx.dashboard()[0]))


@register("return_curves", O.with_ctes(O.dashboard_chain() + [f"""rc AS (
  SELECT f.fecha_corte AS fecha, f.rent, d.nombre_patrimonio || '/' || f.tipo_participacion AS cod_ext
  FROM (SELECT *, {O.rent_sql('crecimiento_dia', 30)} AS rent FROM dash_facts) f
  LEFT JOIN dash_dims d ON d.cod = f.cod)"""],
    sel(["fecha", "rent", "cod_ext"], "rc", "WHERE fecha IS NOT NULL AND rent IS NOT NULL AND cod_ext IS NOT NULL")))
def _return_curves(ctx):
    facts, dims = ctx.dashboard()
    selection = filter_latest_date(facts, "Fecha")
    return return_curves(facts, dims, selection, 30)


# ============================== 2.12 diagnostics ==============================

_NOSHOCK = f"(fecha_corte <= DATE '{SHOCK[0]}' OR fecha_corte >= DATE '{SHOCK[1]}')"
ACF_SQL = O.with_ctes(IDX_CTES + [f"""ax AS (SELECT fecha_corte, mean_creci AS v,
  row_number() OVER (ORDER BY fecha_corte) AS i FROM idx WHERE {_NOSHOCK} AND mean_creci IS NOT NULL)""",
    "ad AS (SELECT i, v - (SELECT avg(v) FROM ax) AS d FROM ax)",
    "lags AS (SELECT CAST(unnest(range(2, 366)) AS INTEGER) AS lag)"],
    sel(["lag", "acf"], """(SELECT l.lag, sum(a.d * b.d) / (SELECT sum(d * d) FROM ad) AS acf
  FROM ad a CROSS JOIN lags l JOIN ad b ON b.i = a.i + l.lag GROUP BY l.lag) t"""))
register("acf", ACF_SQL)(lambda ctx: ST.acf(filter_exclude_period(_index(ctx), *SHOCK), "mean_creci", range(2, 366)))

CCF_SQL = O.with_ctes(IDX_CTES + [_TRM, _IPC, f"""cx AS (
  SELECT x.fecha_corte, x.mean_creci, t.trm, i.ipc FROM idx x LEFT JOIN trm t ON t.fecha = x.fecha_corte
  LEFT JOIN ipc i ON i.fecha = x.fecha_corte WHERE {_NOSHOCK.replace('fecha_corte', 'x.fecha_corte')})""",
    """cc AS (SELECT *, row_number() OVER (ORDER BY fecha_corte) AS i FROM cx
  WHERE mean_creci IS NOT NULL AND trm IS NOT NULL AND ipc IS NOT NULL)""",
    """cs AS (SELECT count(*) AS n, avg(mean_creci) AS mx, stddev_pop(mean_creci) AS sx, avg(trm) AS mt,
  stddev_pop(trm) AS st, avg(ipc) AS mi, stddev_pop(ipc) AS si FROM cc)""",
    "lags AS (SELECT CAST(unnest(range(0, 366)) AS INTEGER) AS lag)",
    """cp AS (SELECT l.lag, sum((a.mean_creci - cs.mx) * (b.trm - cs.mt)) / max(cs.n) / max(cs.sx * cs.st) AS trm,
  sum((a.mean_creci - cs.mx) * (b.ipc - cs.mi)) / max(cs.n) / max(cs.sx * cs.si) AS ipc
  FROM cc b CROSS JOIN lags l JOIN cc a ON a.i = b.i + l.lag CROSS JOIN cs GROUP BY l.lag)"""],
    "SELECT lag, 'trm' AS variable, " + O.r8("trm") + " AS ccf FROM cp UNION ALL "
    "SELECT lag, 'ipc', " + O.r8("ipc") + " FROM cp")


@register("ccf", CCF_SQL)
def _ccf(ctx):
    trm_rows, ipc_rows, _ = _macro(ctx)
    from fundlens.sources.landed import macro_daily, macro_monthly
    x = _index(ctx)
    x = x.join(macro_daily(trm_rows), F.col("fecha_corte") == F.col("fecha"), "left").drop("fecha")
    x = x.join(macro_monthly(ipc_rows), F.col("fecha_corte") == F.col("fecha"), "left").drop("fecha")
    x = filter_exclude_period(x, *SHOCK)
    return ST.ccf(x, "mean_creci", ["trm", "ipc"], range(0, 366))


DEC_CTES = IDX_CTES + ["""dx AS (SELECT fecha_corte, mean_creci AS observed,
  row_number() OVER (ORDER BY fecha_corte) AS i FROM idx)""", """dt AS (SELECT *,
  CASE WHEN count(observed) OVER w = 91 THEN avg(observed) OVER w END AS trend, (i - 1) % 7 AS phase
  FROM dx WINDOW w AS (ORDER BY fecha_corte ROWS BETWEEN 45 PRECEDING AND 45 FOLLOWING))""",
    "dph AS (SELECT phase, avg(observed - trend) AS s FROM dt GROUP BY phase)",
    "dph2 AS (SELECT phase, s - avg(s) OVER () AS season FROM dph)",
    """dec AS (SELECT fecha_corte, observed, trend, season, observed - trend - season AS remainder
  FROM dt LEFT JOIN dph2 USING (phase))"""]
register("decompose", O.with_ctes(DEC_CTES, sel(["fecha_corte", "observed", "trend", "season", "remainder"], "dec")))(
    lambda ctx: ST.decompose(_index(ctx), "mean_creci", period=7, trend=91))

_PROF = ", ".join(["min(v) AS min", "quantile_cont(v, 0.25) AS q25", "quantile_cont(v, 0.5) AS median",
                   "quantile_cont(v, 0.75) AS q75", "max(v) AS max", "avg(v) AS mean", "count(*) AS n"])
PROFILE_SQL = O.with_ctes(IDX_CTES + [f"""sp AS (
  SELECT 'wday.lbl' AS feature, dayname(fecha_corte) AS grupo, mean_creci AS v FROM idx WHERE {_NOSHOCK}
  UNION ALL SELECT 'month.lbl', monthname(fecha_corte), mean_creci FROM idx WHERE {_NOSHOCK}
  UNION ALL SELECT 'year', CAST(year(fecha_corte) AS VARCHAR), mean_creci FROM idx WHERE {_NOSHOCK})""",
    f"spa AS (SELECT feature, grupo, {_PROF} FROM sp WHERE v IS NOT NULL GROUP BY ALL)"],
    sel(["feature", "grupo", "min", "q25", "median", "q75", "max", "mean", "n"], "spa"))


@register("seasonal_profile", PROFILE_SQL)
def _seasonal_profile(ctx):
    x = filter_exclude_period(_index(ctx), *SHOCK)
    parts = [ST.seasonal_profile(x, "mean_creci", f).select(F.lit(f).alias("feature"), "*")
             for f in ("wday.lbl", "month.lbl", "year")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TVM_SQL = O.with_ctes(DEC_CTES + [_TRM, _IPC, """tv AS (SELECT d.fecha_corte, d.trend AS creci_trend, t.trm, i.ipc
  FROM dec d LEFT JOIN trm t ON t.fecha = d.fecha_corte LEFT JOIN ipc i ON i.fecha = d.fecha_corte)""",
    """tz AS (SELECT fecha_corte,
  (creci_trend - avg(creci_trend) OVER ()) / stddev_samp(creci_trend) OVER () AS creci_trend,
  (trm - avg(trm) OVER ()) / stddev_samp(trm) OVER () AS trm,
  (ipc - avg(ipc) OVER ()) / stddev_samp(ipc) OVER () AS ipc FROM tv)"""],
    " UNION ALL ".join(f"SELECT fecha_corte, '{c}' AS name, {O.r8(c)} AS value FROM tz"
                       for c in ("creci_trend", "trm", "ipc")))


@register("trend_vs_macro", TVM_SQL)
def _trend_vs_macro(ctx):
    from fundlens.sources.landed import macro_daily, macro_monthly
    trm_rows, ipc_rows, _ = _macro(ctx)
    d = ST.decompose(_index(ctx), "mean_creci").select("fecha_corte", F.col("trend").alias("creci_trend"))
    d = d.join(macro_daily(trm_rows), F.col("fecha_corte") == F.col("fecha"), "left").drop("fecha")
    d = d.join(macro_monthly(ipc_rows), F.col("fecha_corte") == F.col("fecha"), "left").drop("fecha")
    z = FC.standardize(d, ["creci_trend", "trm", "ipc"])
    return ST.unpivot_long(z, ["fecha_corte"], ["creci_trend", "trm", "ipc"])


# ============================== 2.13 features (M2-M5) ==============================

register("calendar_features", O.with_ctes(DS_CTES, sel(DS_COLS + ["day_of_week", "day_of_month", "day_of_year"],
    """(SELECT *, CAST(isodow(fecha_corte) - 1 AS INTEGER) AS day_of_week,
        CAST(dayofmonth(fecha_corte) AS INTEGER) AS day_of_month,
        CAST(dayofyear(fecha_corte) AS INTEGER) AS day_of_year FROM ds) t""")))(lambda ctx: FC.calendar_features(_ds(ctx)))
_LAGW = "PARTITION BY cod ORDER BY fecha_corte"
NUM.update(f"lag_{n}" for n in FC.TARGET_LAGS)
register("lag_features", O.with_ctes(DS_CTES, sel(DS_COLS + [f"lag_{n}" for n in FC.TARGET_LAGS],
    "(SELECT *, " + ", ".join(f"lag(creci_dia, {n}) OVER ({_LAGW}) AS lag_{n}" for n in FC.TARGET_LAGS) + " FROM ds) t")))(
    lambda ctx: FC.lag_features(_ds(ctx)))
register("age_observed_features", O.with_ctes(DS_CTES, sel(DS_COLS + ["age", "observed", "creci_dia_filled"], f"""(SELECT *,
  log10(2.0 + (row_number() OVER ({_LAGW}) - 1)) AS age, CAST(creci_dia IS NOT NULL AS DOUBLE) AS observed,
  coalesce(creci_dia, 0.0) AS creci_dia_filled FROM ds) t""")))(lambda ctx: FC.age_observed_features(_ds(ctx)))
register("mean_scaling", O.with_ctes(DS_CTES + ["""msc AS (SELECT *, CASE WHEN avg(abs(creci_dia)) OVER (PARTITION BY cod) = 0
  OR avg(abs(creci_dia)) OVER (PARTITION BY cod) IS NULL THEN 1.0 ELSE avg(abs(creci_dia)) OVER (PARTITION BY cod) END AS scale FROM ds)"""],
    sel(DS_COLS + ["scale", "creci_dia_scaled"], "(SELECT *, creci_dia / scale AS creci_dia_scaled FROM msc) t")))(
    lambda ctx: FC.mean_scaling(_ds(ctx)))


# ============================== D8 parameter grid ==============================

ALGORITHMS = ("kmeans", "gmm", "bisecting")
GRID_KS = (5, 7, 9)


def parameter_grid(spark, algorithms=ALGORITHMS, ks=GRID_KS):
    """All non-empty algorithm subsets x k (D8), the input of the sweep: a
    bitmask range crossed with the k list."""
    masks = spark.range(1, 2 ** len(algorithms)).select(F.col("id").cast("int").alias("subset"))
    names = F.concat_ws("+", *[F.when((F.col("subset").bitwiseAND(1 << i)) != 0, F.lit(a))
                               for i, a in enumerate(algorithms)])
    return masks.select("subset", names.alias("algorithms"), F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))


register("grid_cross", O.with_ctes(MOVING_CTES, """SELECT CAST(m AS INTEGER) AS subset,
  concat_ws('+', CASE WHEN m & 1 <> 0 THEN 'kmeans' END, CASE WHEN m & 2 <> 0 THEN 'gmm' END,
            CASE WHEN m & 4 <> 0 THEN 'bisecting' END) AS algorithms, k,
  k < (SELECT count(DISTINCT cod) FROM moving) AS feasible
  FROM range(1, 8) t(m) CROSS JOIN (VALUES (5), (7), (9)) v(k)"""))(
    lambda ctx: parameter_grid(ctx.spark).withColumn(
        "feasible", F.col("k") < _moving(ctx).agg(F.countDistinct("cod").alias("n")).scalar()))
