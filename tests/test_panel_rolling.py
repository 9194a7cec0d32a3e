"""Invariants of the panel cleaning and the rolling statistics."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.operators.joins import anti, semi
from fundlens.operators.panel import (CARRY, accrue_from_rate, clean_panel, daily_growth, fill_flows, locf,
                                      merge_sources, pad_daily)
from fundlens.operators.rolling import (multi_period_risk, rolling, rolling_return_ann, rolling_return_gross,
                                        rolling_stats, rolling_vol_ann)

D = dt.date
FACT_SCHEMA = ("fecha_corte date, cod string, tipo_participacion string, rendimientos_abonados double, "
               "precierre_fondo_dia_t double, numero_unidades_fondo_cierre double, valor_unidad_operaciones double, "
               "valor_fondo_cierre_dia_t double, numero_inversionistas double, transaccciones_netas double")


def _facts(spark):
    rows = []
    for day, close in [(1, None), (2, 100.0), (3, 101.0), (5, 103.0), (45, 110.0)]:
        rows.append((D(2020, 1, day) if day <= 31 else D(2020, 2, day - 31), "c1", "A", 1.0,
                     None if close is None else close - 1, 10.0, 1.0, close, 5.0, 2.0))
    rows.append((D(2020, 1, 10), "c2", "B", 0.5, 50.0, 1.0, 1.0, 50.5, 1.0, 0.0))
    return spark.createDataFrame(rows, FACT_SCHEMA)


def test_pad_counts_and_observed_rows(spark):
    f = _facts(spark)
    p = pad_daily(f)
    per = {r["cod"]: r["n"] for r in p.groupBy("cod").agg(F.count("*").alias("n")).collect()}
    assert per == {"c1": (D(2020, 2, 14) - D(2020, 1, 1)).days + 1, "c2": 1}
    observed = p.join(f.select("cod", "tipo_participacion", "fecha_corte"),
                      ["cod", "tipo_participacion", "fecha_corte"], "left_semi")
    assert observed.count() == f.count()
    # added days: flows NULL, carried columns = last observation; leading NULL stays
    byday = {r["fecha_corte"]: r for r in p.where("cod = 'c1'").collect()}
    assert byday[D(2020, 1, 1)]["valor_fondo_cierre_dia_t"] is None
    assert byday[D(2020, 1, 4)]["valor_fondo_cierre_dia_t"] == 101.0
    assert byday[D(2020, 1, 4)]["rendimientos_abonados"] is None
    assert byday[D(2020, 2, 13)]["valor_fondo_cierre_dia_t"] == 103.0


def test_pad_then_locf_equals_carry_in_pad(spark):
    f = _facts(spark)
    a = locf(pad_daily(f, fill_carry=False), CARRY)
    b = pad_daily(f)
    cols = ["cod", "tipo_participacion", "fecha_corte", *CARRY]
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))


def test_fill_flows(spark):
    r = fill_flows(pad_daily(_facts(spark))).where("cod = 'c1' AND fecha_corte = DATE'2020-01-04'").first()
    assert r["rendimientos_abonados"] == 0.0 and r["transaccciones_netas"] == 0.0
    assert r["precierre_fondo_dia_t"] == 101.0


def test_merge_equals_join_formulation(spark):
    """The single-pass merge equals the semi/anti-join formulation."""
    facts = spark.createDataFrame([
        (D(2020, 3, 5), "k1", "A", 1.0, 99.0, 1.0, 1.0, 100.0, 1.0, 0.0),
        (D(2020, 1, 5), "k2", "A", 1.0, 99.0, 1.0, 1.0, 100.0, 1.0, 0.0),
    ], FACT_SCHEMA)
    rep = spark.createDataFrame([
        (D(2020, 3, d), c, "A", 100.0 + d, 2.0, 1.0001, 10.0, 1.0)
        for c in ("k1", "k2", None) for d in (1, 2, 4, 5, 6)
    ], "fecha_corte date, cod string, tipo_participacion string, valor_fondo_cierre_dia_t double, "
       "numero_inversionistas double, factor_dia double, numero_unidades_fondo_cierre double, "
       "valor_unidad_operaciones double")
    as_of = D(2020, 3, 31)
    got = merge_sources(facts, rep, as_of)
    acc = accrue_from_rate(rep)
    acc = semi(acc, facts.where(F.col("fecha_corte") >= F.lit(D(2020, 2, 1))), ["cod", "tipo_participacion"])
    acc = acc.withColumn("transaccciones_netas", F.col("valor_fondo_cierre_dia_t") - F.col("precierre_fondo_dia_t"))
    acc = anti(acc, facts, ["fecha_corte", "cod", "tipo_participacion"])
    want = facts.unionByName(acc, allowMissingColumns=True).select(*facts.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # k1: first report day dropped, 5 March held by the facts; k2 not recent
    assert got.where("cod = 'k1'").count() == 1 + 3
    assert got.where("cod = 'k2'").count() == 1


def test_clean_panel_columns(spark):
    p = clean_panel(_facts(spark))
    assert p.columns[-1] == "crecimiento_dia" and p.where("crecimiento_dia IS NULL").count() == 1


def _random_series(spark, n=400, seed=7, odd=None):
    """Two series of ``n`` days with a NULL on day 300; ``odd`` maps days to other values."""
    rnd = random.Random(seed)
    rows = []
    for cod in ("a", "b"):
        for i in range(n):
            g = rnd.gauss(0.0003, 0.002)
            if cod == "a":
                g = (odd or {}).get(i, g)
            if i == 300:
                g = None
            rows.append((D(2019, 1, 1) + dt.timedelta(days=i), cod, "A", g))
    return spark.createDataFrame(rows, "fecha_corte date, cod string, tipo_participacion string, crecimiento_dia double")


@pytest.mark.parametrize("odd", [{}, {50: -1.0, 230: -1.5}, {20: 1e6}, {20: 1e3, 200: -1e5}, {40: float("nan")},
                                 {40: float("inf"), 250: float("-inf")}])
def test_rolling_equals_the_moving_frame(spark, odd):
    """Every period agrees with the aggregate over the plain frame, after a spike, a NaN or an infinity too."""
    df = _random_series(spark, odd=odd)
    for p in (1, 2, 5, 30, 61, 120, 365):
        got = rolling_stats(df, [("r", "ann", p, "crecimiento_dia"), ("g", "gross", p, "crecimiento_dia"),
                                 ("v", "vol", p, "crecimiento_dia")])
        got = rolling(rolling(got, "crecimiento_dia", p, lambda c: F.product(1 + c), "prod"), "crecimiento_dia", p, F.stddev_samp, "sd")
        got = got.withColumn("ann", F.pow("prod", F.lit(365 / p)) - 1)
        for r in got.collect():
            gross, sd = r["prod"], r["sd"]
            want = {"g": None if gross is None else gross - 1, "v": None if sd is None else sd * 365 ** 0.5}
            want["r"] = r["ann"]
            for c, x in want.items():
                y = r[c]
                if x is None or y is None:
                    assert x is None and y is None, (p, r)
                elif np.isnan(x) or np.isinf(x):
                    assert np.isnan(y) if np.isnan(x) else y == x, (p, r)
                else:
                    assert y == pytest.approx(x, rel=1e-9, abs=1e-12), (p, c, r)


def test_growth_that_is_not_finite_is_zero(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(D(2020, 1, 1 + i), *v) for i, v in enumerate([(nan, 1.0), (10.0, nan), (inf, 1.0), (10.0, inf), (10.0, 1.0), (None, 1.0)])]
    df = spark.createDataFrame([(d, y, 0.0, p, 100.0) for d, p, y in rows],
                               "fecha_corte date, rendimientos_abonados double, transaccciones_netas double, "
                               "precierre_fondo_dia_t double, valor_fondo_cierre_dia_t double")
    got = [r[0] for r in daily_growth(fill_flows(df)).orderBy("fecha_corte").select("crecimiento_dia").collect()]
    assert got == [pytest.approx(100 / 99 - 1), 0.0, 0.0, pytest.approx(-1.0), pytest.approx(10 / 9 - 1), pytest.approx(100 / 99 - 1)]


def test_gross_vs_annualised(spark):
    df = _random_series(spark)
    out = rolling_return_gross(rolling_return_ann(df, 30), 30).dropna().collect()
    for r in out[:50]:
        assert r["rent_brut_30"] == pytest.approx((1 + r["rent_30"]) ** (30 / 365) - 1, rel=1e-9, abs=1e-13)


def test_vol_matches_numpy(spark):
    df = _random_series(spark, n=100)
    out = rolling_vol_ann(df, 10).where("cod = 'a'").orderBy("fecha_corte").collect()
    g = np.array([r["crecimiento_dia"] for r in out], dtype=float)
    for i in (9, 50, 99):
        assert out[i]["vol_10"] == pytest.approx(np.std(g[i - 9:i + 1], ddof=1) * np.sqrt(365), rel=1e-9)


def test_rolling_udf_any_aggregate(spark):
    df = _random_series(spark, n=50)
    out = rolling(df, "crecimiento_dia", 5, F.max, "mx").where("cod = 'a'").orderBy("fecha_corte").collect()
    g = [r["crecimiento_dia"] for r in out]
    assert out[3]["mx"] is None and out[10]["mx"] == max(g[6:11])


def test_multi_period_single_exchange(spark):
    df = _random_series(spark).repartition(3)
    plan = multi_period_risk(df, (30, 365))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
