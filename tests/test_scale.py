"""What is stored and moved: the panel as runs, the model dataset by fund, forecasts of the last week only."""

import datetime as dt

from conftest import SMOKE, rows
from pyspark.sql import functions as F

from fundlens.operators import forecast as FC
from fundlens.operators.panel import clean_panel
from fundlens.operators.universe import screen_universe
from fundlens.plans import context
from fundlens.plans.queries_stats import _ds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_lists_the_days_of_stored_runs(spark):
    context.clear_cache()
    ctx = context.Ctx(spark, SMOKE)
    panel = ctx.panel(2)
    runs = ctx.runs(2)
    assert runs.count() < panel.count() == runs.agg(F.sum("dias")).first()[0]
    assert "fundlens_runs_" in _plan(panel) and "Generate explode" in _plan(panel)
    # by series without a move, as the runs are stored
    assert "Exchange" not in _plan(panel.groupBy("cod", "tipo_participacion").count())
    assert rows(panel) == rows(clean_panel(ctx.facts(2), ctx.report(), ctx.as_of))
    assert rows(ctx.base5()) == rows(screen_universe(ctx.panel(5), 365, base=True))


def test_buckets_follow_the_rows(spark, monkeypatch):
    context.clear_cache()
    monkeypatch.setattr(context, "ROWS_PER_BUCKET", 500)
    ctx = context.Ctx(spark, SMOKE)
    lines = spark.read.parquet(f"{SMOKE}/lineitem.parquet").count()
    assert ctx.buckets() == -(-lines // 500)
    n = ctx.buckets()
    assert f"SelectedBucketsCount: {n} out of {n}" in _plan(ctx.panel(2).groupBy("cod", "tipo_participacion").count())
    context.clear_cache()


def test_model_dataset_is_stored_by_fund(spark):
    context.clear_cache()
    ds = _ds(context.Ctx(spark, SMOKE))
    assert "Exchange hashpartitioning(cod" not in _plan(FC.lag_features(ds))


def test_future_control_repeats_the_last_week(spark):
    day = dt.date(2024, 1, 1)
    data = [("a", day + dt.timedelta(i), float(i)) for i in range(20) if i != 16]
    data += [("b", day + dt.timedelta(i), -float(i)) for i in range(3)] + [("a", day + dt.timedelta(19), 99.0)]
    df = spark.createDataFrame(data, "cod string, fecha_corte date, creci_dia double").repartition(3, "cod")
    want = []
    for cod, last in (("a", 19), ("b", 2)):
        for h in range(1, 29):
            src = day + dt.timedelta(last + (h - 1) % 7 - 6)
            found = [v for c, d, v in data if c == cod and d == src] or [None]
            want += [(cod, day + dt.timedelta(last + h), v) for v in found]
    got = FC.seasonal_naive_future(df)
    assert rows(got) == sorted(want, key=repr)
    assert "Join" not in _plan(got)
