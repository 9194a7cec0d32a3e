"""Hand-made micro fixtures for the traps of SURVEY 1.4."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from fundlens.functions.dates import ceiling_month, py_add_months, shift_months, shift_years
from fundlens.functions.keys import composite_key
from fundlens.functions.numeric import safe_growth
from fundlens.functions.text import clean_fund_name, entity_key, trim_ws
from fundlens.operators.panel import daily_growth
from fundlens.operators.rolling import clamp_period, multi_period_risk, rolling_return_ann
from fundlens.operators.stats import grouped_min_median
from fundlens.operators.universe import base_share_class, long_series
from fundlens.sources.landed import report_rows

D = dt.date


def test_t1_key_missing_parts(spark):
    df = spark.createDataFrame([("5", None, "1", "9")], "a string, b string, c string, d string")
    r = df.select(composite_key("a", "b", "c", "d").alias("k"),
                  composite_key("a", "b", "c", "d", missing=None).alias("n")).first()
    assert r["k"] == "5_NA_1_9"
    assert r["n"] is None


def test_t2_zero_denominator(spark):
    df = spark.createDataFrame([(10.0, 10.0), (0.0, 0.0), (None, 1.0), (11.0, 1.0)], "pre double, y double")
    got = [r[0] for r in df.select(safe_growth(F.col("pre"), F.col("y"))).collect()]
    assert got[0] == 0.0 and got[1] == 0.0 and got[2] is None
    assert got[3] == pytest.approx(11.0 / 10.0 - 1)


def _series(spark, values, start=D(2020, 1, 1), cod="c", part="A"):
    data = [(start + dt.timedelta(days=i), cod, part, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "fecha_corte date, cod string, tipo_participacion string, "
                                       "crecimiento_dia double")


def test_t3_t4_null_in_frame_and_short_series(spark):
    df = _series(spark, [0.01, 0.02, None, 0.01, 0.0, 0.01])
    out = rolling_return_ann(df, 3).orderBy("fecha_corte").collect()
    vals = [r["rent_3"] for r in out]
    assert vals[0] is None and vals[1] is None           # frame not full yet
    assert vals[2] is None and vals[3] is None and vals[4] is None  # NULL inside the frame
    assert vals[5] == pytest.approx((1.01 * 1.0 * 1.01) ** (365 / 3) - 1)
    short = rolling_return_ann(_series(spark, [0.01, 0.02]), 30)
    assert all(r["rent_30"] is None for r in short.collect())


def test_t5_strict_day_count(spark):
    a = _series(spark, [0.0] * 365, cod="a")
    b = _series(spark, [0.0] * 366, cod="b")
    kept = long_series(a.unionByName(b), 365).select("cod").distinct().collect()
    assert [r[0] for r in kept] == ["b"]


def test_t6_report_subtype_mapping(spark):
    raw = spark.createDataFrame([
        ("01/02/2020", "5", "16", "10", "FIC DE TIPO GENERAL", "", "A", "$ 1,234.50", "10", "3.65", "1,000", "1.2345"),
        ("01/02/2020", "5", "16", "11", "DESCONOCIDO", "", "A", "$ 1.00", "1", "1", "1", "1"),
        ("31/02/2020", "5", "16", "12", "FONDOS DE CAPITAL PRIVADO", "", "A", "1", "1", "1", "1", "1"),
        ("bad", "5", "16", "13", "FIC BURSATILES", "2", "B", "x", "1", "1", "1", "1"),
    ], ", ".join(f"{c} string" for c in ("fecha_corte", "tipo_entidad", "cod_entidad", "cod_negocio",
                                          "subtipo_negocio", "cons_id_part", "tipo_part", "valor_fondo_cierre",
                                          "num_inversionistas", "rentab_dia", "num_unidades", "valor_unidad")))
    out = {r["cod"]: r for r in report_rows(raw).collect()}
    assert "5_16_1_10" in out and out["5_16_1_10"]["valor_fondo_cierre_dia_t"] == 1234.5
    assert out["5_16_1_10"]["factor_dia"] == pytest.approx(1.0365 ** (1 / 365))
    assert out["5_16_1_10"]["fecha_corte"] == D(2020, 2, 1)
    assert None in out                                  # unknown subtype -> NULL key
    assert len(out) == 3                                # excluded subtype dropped
    bad = out["5_16_1_13"]
    assert bad["fecha_corte"] is None and bad["tipo_participacion"] == "B2"


def test_t9_round_half_up(spark):
    df = spark.createDataFrame([(0.25, 0.15, 12.35)], "a double, b double, c double")
    r = df.select(F.round("a", 1), F.round("b", 1), F.round("c", 1)).first()
    assert tuple(r) == (0.3, 0.2, 12.4)


def test_t10_percentile_type7(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double")
    r = df.select(F.percentile("x", [0.25, 0.5, 0.75])).first()[0]
    assert r == [1.75, 2.5, 3.25]


def test_t3_median_propagates_null(spark):
    df = spark.createDataFrame([("e1", "a", 1.0), ("e1", "a", None), ("e1", "b", 2.0), ("e2", "c", 3.0)],
                               "ent string, cod string, v double")
    out = {(r["ent"], r["cod"]): r for r in grouped_min_median(df, "ent", "cod", "v").collect()}
    assert out[("e1", "a")]["mediana"] is None
    assert out[("e1", "b")]["mediana_emp"] is None      # NULL median inside the entity
    assert out[("e2", "c")]["mediana_emp"] == 3.0


def test_t13_t14_regex_and_trim(spark):
    df = spark.createDataFrame([("abc",), ("5_16_1_10",)], "c string")
    got = [r[0] for r in df.select(entity_key(F.col("c"))).collect()]
    assert got == [None, "5_16"]
    t = spark.createDataFrame([("\tFONDO DE INVERSION COLECTIVA ABC \n",)], "n string")
    assert t.select(clean_fund_name(F.col("n"))).first()[0] == "ABC"
    assert t.select(trim_ws(F.lit("\t x \n"))).first()[0] == "x"


def test_t15_period_clamp():
    assert clamp_period(None, 30) == 30
    assert clamp_period("-", 365) == 365
    assert clamp_period(0, 30) == 1
    assert clamp_period(400, 30) == 365
    assert clamp_period("45", 30) == 45


def test_t15_equal_periods_once(spark):
    df = _series(spark, [0.001] * 40)
    out = multi_period_risk(df, (30, 30))
    assert [c for c in out.columns if c.startswith(("rent", "vol"))] == ["rent_30", "vol_30"]


def test_t19_month_shift_clips(spark):
    df = spark.createDataFrame([(D(2024, 3, 31), D(2024, 2, 29))], "a date, b date")
    r = df.select(shift_months(F.col("a"), -1), shift_years(F.col("b"), -1), ceiling_month(F.col("b")),
                  ceiling_month(F.lit(D(2024, 3, 1)))).first()
    assert tuple(r) == (D(2024, 2, 29), D(2023, 2, 28), D(2024, 3, 1), D(2024, 4, 1))
    assert py_add_months(D(2024, 3, 31), -1) == D(2024, 2, 29)


def test_u3_base_share_ties_and_nulls(spark):
    last = D(2020, 1, 2)
    data = [
        (last, "f1", "A", 10.0, 100.0), (last, "f1", "B", 10.0, 200.0), (last, "f1", "C", 5.0, 900.0),
        (last, "f2", "A", 0.0, 1.0), (last, "f2", "B", 0.0, 2.0),
        (last, "f3", "A", None, 1.0), (last, "f3", "B", 3.0, 2.0),
        (last, "f4", "A", 7.0, 5.0), (last, "f4", "B", 7.0, 5.0),
        (D(2020, 1, 1), "f1", "B", 1.0, 1.0),
    ]
    df = spark.createDataFrame(data, "fecha_corte date, cod string, tipo_participacion string, "
                                     "numero_inversionistas double, valor_fondo_cierre_dia_t double")
    got = sorted(set((r["cod"], r["tipo_participacion"]) for r in base_share_class(df).collect()))
    assert got == [("f1", "B"), ("f4", "A")]            # ties -> value, then first participation
    assert base_share_class(df).where("cod = 'f1'").count() == 2   # whole history kept


def test_t11_renamed_fund_fans_out(spark):
    from fundlens.operators.joins import left_lookup
    facts = spark.createDataFrame([("k", 1.0)], "cod string, v double")
    dims = spark.createDataFrame([("k", "OLD"), ("k", "NEW")], "cod string, name string")
    assert left_lookup(facts, dims, "cod").count() == 2


def test_growth_rounding_path(spark):
    df = spark.createDataFrame([(12.34, 1000.05)], "rendimientos_abonados double, precierre_fondo_dia_t double")
    r = daily_growth(df).first()
    assert r["rendimientos_abonados"] == 12.3 and r["precierre_fondo_dia_t"] == 1000.1
    assert math.isclose(r["crecimiento_dia"], 1000.1 / (1000.1 - 12.3) - 1)
