"""Dims cleaning and the dashboard / forecast report operators on tiny fixtures."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fundlens.operators.dims import clean_dims
from fundlens.plans.report import (DASHBOARD_DIM_NAMES, DASHBOARD_FACT_NAMES, format_display, forecast_report,
                                   rename_all, return_curves, summary_table)

D = dt.date


def test_clean_dims(spark):
    raw = spark.createDataFrame([
        ("5", "SOCIEDADES FIDUCIARIAS", "16", "ORIGINAL", "1", "10", " Fondo de Inversion Colectiva Alfa\t"),
        ("85", "SOCIEDADES COMISIONISTAS DE BOLSA", "99", "KEEP NAME", "2", "11", "F.I.C. BETA"),
        ("87", "SOCIEDADES ADMINISTRADORAS DE INVERSION", "11", "X", "1", "12", "CARTERA COLECTIVA GAMMA"),
    ], "tipo_entidad string, nombre_tipo_entidad string, codigo_entidad string, nombre_entidad string, "
       "subtipo_negocio string, codigo_negocio string, nombre_patrimonio string")
    out = {r["cod"]: r for r in clean_dims(raw).collect()}
    assert set(out) == {"5_16_1_10", "85_99_2_11", "87_11_1_12"}
    assert out["5_16_1_10"]["nombre_tipo_entidad"] == "FIDUCIARIAS"
    assert out["5_16_1_10"]["nombre_entidad"] == "ALIANZA FIDUCIARIA"          # lookup hit
    assert out["5_16_1_10"]["nombre_patrimonio"] == "ALFA"
    assert out["85_99_2_11"]["nombre_tipo_entidad"] == "COMISIONISTAS"
    assert out["85_99_2_11"]["nombre_entidad"] == "KEEP NAME"                  # no lookup entry
    assert out["85_99_2_11"]["nombre_patrimonio"] == "BETA"
    assert out["87_11_1_12"]["nombre_tipo_entidad"] == "ADMINISTRADORAS"
    assert out["87_11_1_12"]["nombre_entidad"] == "PROGRESION ADMINISTRADORA"
    assert out["87_11_1_12"]["nombre_patrimonio"] == "GAMMA"


def _dashboard(spark, days=40):
    rows = []
    for cod, part, base in (("5_16_1_10", "A", 0.001), ("5_16_1_10", "B", 0.002), ("85_3_1_9", "A", -0.001)):
        for i in range(days):
            g = base * (1 + (i % 3))
            rows.append((D(2020, 1, 1) + dt.timedelta(days=i), cod, part, 1.0, 99.0, 10.0, 1.234567, 100.0 + i,
                         5.0, 2.0 if i % 2 else 0.0, g))
    facts = spark.createDataFrame(rows, "a date, b string, c string, d double, e double, f double, g double, "
                                        "h double, i double, j double, k double").toDF(*DASHBOARD_FACT_NAMES)
    dims = spark.createDataFrame([("5_16_1_10", "FIDUCIARIAS", "ALIANZA FIDUCIARIA", "ALFA"),
                                  ("85_3_1_9", "COMISIONISTAS", "ACCIONE Y VALORES COMISIONISTA", "OMEGA")],
                                 "a string, b string, c string, d string").toDF(*DASHBOARD_DIM_NAMES)
    return facts, dims


def test_summary_table_values_and_periods(spark):
    facts, dims = _dashboard(spark)
    out = {(r["fondo"], r["participacion"]): r for r in summary_table(facts, dims, 10, 400).collect()}
    assert len(out) == 3
    g = [0.001 * (1 + (i % 3)) for i in range(40)]
    want = math.prod(1 + x for x in g[-10:]) ** (365 / 10) - 1
    r = out[("ALFA", "A")]
    assert r["rent_10"] == pytest.approx(want, rel=1e-12)
    assert r["rent_365"] is None                      # period 400 clamped to 365 > 40 days
    assert r["valor_unidad"] == 1.23 and r["valor_cierre"] == 139.0
    same = summary_table(facts, dims, 30, 30)
    assert [c for c in same.columns if c.startswith(("rent", "vol"))] == ["rent_30", "vol_30"]
    titled = summary_table(facts, dims, 30, 365, titles=True)
    assert titled.columns[:5] == ["Nombre Entidad", "Fondo", "Particip.", "Rent 30", "Rent 365"]


def test_format_display(spark):
    facts, dims = _dashboard(spark)
    r = format_display(summary_table(facts, dims, 10, 20)).where("fondo = 'OMEGA'").first()
    assert r["nombre_entidad"] == "ACCIONE Y VALORES CO…"   # 20 characters + ellipsis
    assert r["valor_cierre"] == "$0M" and r["valor_unidad"] == "$1.23"
    assert r["rent_10"].endswith("%")


def test_return_curves(spark):
    facts, dims = _dashboard(spark)
    sel = facts.where((F.col("cod") == "5_16_1_10") & (F.col("Participacion") == "B")).select("cod", "Participacion")
    out = return_curves(facts, dims, sel, 30).collect()
    assert len(out) == 40 - 29 and {r["cod_ext"] for r in out} == {"ALFA/B"}


def test_forecast_report_labels(spark):
    actual = spark.createDataFrame([("f", D(2020, 1, 1), 0.001, 0.0)],
                                   "cod string, fecha_corte date, creci_dia double, dia_no_habil double")
    fc = spark.createDataFrame([("f", D(2020, 1, 2), 0.002, 0.0015, 0.0025)],
                               "cod string, fecha_corte date, mean double, q25 double, q75 double")
    out = {r["key"]: r for r in forecast_report(actual, fc).collect()}
    assert out["actual"]["model_desc"] == "ACTUAL" and out["actual"]["model_id"] is None
    assert out["prediction"]["model_id"] == 1 and out["prediction"]["conf_hi"] == 0.0025


def test_rename_all_positional(spark):
    facts, _ = _dashboard(spark)
    assert rename_all(facts, [c.lower() for c in facts.columns]).columns[0] == "fecha"
