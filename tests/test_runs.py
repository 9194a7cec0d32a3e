"""The panel as runs against the padded panel."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from fundlens.operators.panel import clean_panel
from fundlens.operators.rolling import multi_period_risk
from fundlens.operators.runs import expand_days, last_day_stats, list_days, rolling_days, rolling_runs, run_panel

SCHEMA = ("fecha_corte date, cod string, tipo_participacion int, rendimientos_abonados double, precierre_fondo_dia_t double, "
          "numero_unidades_fondo_cierre double, valor_unidad_operaciones double, valor_fondo_cierre_dia_t double, "
          "numero_inversionistas double, transaccciones_netas double")
NAN, START = float("nan"), dt.date(2021, 1, 1)


def facts(spark, seed, series=25, days=160):
    """Gaps of every size, missing balances at the start, missing pre-closes, zero closes, huge and not-a-number days."""
    rnd = random.Random(seed)
    rows = []
    for s in range(series):
        day, known = rnd.randrange(30), rnd.choice([0, 0, 1, 4])
        density = rnd.choice([1, 3, 25])
        n = 0
        while day < days:
            closing = None if n < known else rnd.choice([1000.0, 1234.5, 900.0, None, 0.0 if rnd.random() < 0.1 else 5.0, NAN if rnd.random() < 0.05 else 7.0])
            pre = rnd.choice([1000.0, 1e9, None, 999.0, NAN, 0.0]) if rnd.random() < 0.6 else 1001.0
            yld = rnd.choice([0.5, -0.7, None, NAN, 1e12, 1.0]) if rnd.random() < 0.4 else rnd.gauss(0, 1)
            rows.append((START + dt.timedelta(days=day), f"f{s}", s % 2, yld, pre, 10.0, 1.0, closing, rnd.choice([3.0, None]), rnd.choice([None, 2.0, NAN])))
            n += 1
            day += rnd.randrange(1, density + 1)
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b, tolerance=0.0):
    if a is None or b is None or isinstance(a, (str, dt.date)):
        return a == b
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))


def equal(left, right, columns, tolerance=0.0):
    key = lambda r: (r["cod"], r["tipo_participacion"], r["fecha_corte"])
    a, b = sorted(left.collect(), key=key), sorted(right.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    for x, y in zip(a, b):
        for c in columns:
            assert same(x[c], y[c], tolerance), (key(x), c, x[c], y[c])


@pytest.mark.parametrize("seed", [1, 2])
def test_days_of_runs_are_the_padded_panel(spark, seed):
    df = facts(spark, seed)
    panel = clean_panel(df)
    equal(expand_days(run_panel(df)), panel, panel.columns)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rolling_on_runs_equals_rolling_on_days(spark, seed):
    df = facts(spark, seed)
    periods = (1, 7, 30, 90)
    want = multi_period_risk(clean_panel(df), periods)
    got = list_days(rolling_runs(run_panel(df), periods))
    equal(got, want, ["crecimiento_dia", *[f"{k}_{p}" for k in ("rent", "vol") for p in periods]], 1e-10)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_last_day_equals_the_last_row(spark, seed):
    df = facts(spark, seed)
    periods = (1, 30, 90, 150)
    days = multi_period_risk(clean_panel(df), periods)
    last = days.join(days.groupBy("cod", "tipo_participacion").agg(F.max("fecha_corte").alias("fecha_corte")), ["cod", "tipo_participacion", "fecha_corte"])
    got = last_day_stats(run_panel(df), periods).join(last.select("cod", "tipo_participacion", "fecha_corte"), ["cod", "tipo_participacion"])
    equal(got, last, [f"{k}_{p}" for k in ("rent", "vol") for p in periods], 1e-10)


def test_one_sort_and_no_listed_day(spark):
    plan = rolling_runs(run_panel(facts(spark, 1, series=2)).checkpoint(), (30, 90, 365))._jdf.queryExecution().executedPlan().toString()
    events = plan[:plan.index("Generate")]                    # above the events
    assert events.count("Sort [") == 1 and events.count("Window [") == 1
    assert "sequence(" not in plan


@pytest.mark.parametrize("seed,twice", [(1, False), (2, False), (3, True)])
def test_days_with_windows_keep_all_columns(spark, seed, twice):
    """Equal to the windows over listed days, also where a series' days come twice."""
    df = facts(spark, seed, series=12)
    df = df.union(df.where("cod < 'f2'")) if twice else df
    periods = (1, 7, 30)
    want = multi_period_risk(expand_days(run_panel(df)), periods)
    got = rolling_days(run_panel(df), periods)
    assert got.columns == want.columns
    if twice:                                                 # rows of one day have no order of their own
        listed = [sorted(map(repr, x.drop(*[c for c in x.columns if c[:4] in ("rent", "vol_")]).collect())) for x in (got, want)]
        assert listed[0] == listed[1]
        count = lambda rows: {(r["cod"], r["tipo_participacion"]): (r["n"], r["w"]) for r in rows.groupBy("cod", "tipo_participacion").agg(
            F.count("*").alias("n"), F.count("rent_30").alias("w")).collect()}
        assert count(got) == count(want)
    else:
        equal(got, want, want.columns, 1e-10)
    equal(rolling_days(run_panel(df), periods, full=True), got.dropna(subset=[f"{k}_{p}" for k in ("rent", "vol") for p in periods]), ["fecha_corte"])


def test_rows_without_nulls_are_listed_last(spark):
    """``drop_nulls`` sorts and windows stored runs, not the days that it lists."""
    import __spark_entry__ as E

    plan = E.queries()["drop_nulls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    listing = plan[:plan.index("Window [")]
    assert "sequence(" in listing and "Sort [" not in listing[:listing.index("sequence(")]
