"""Blocks with borders against plain numpy; the day pivot."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.operators import blocks, stats

D0 = dt.date(2020, 1, 1)


def series(spark, n, seed=1, by=1):
    rng = np.random.default_rng(seed)
    xs = rng.normal(size=(by, n)).cumsum(axis=1)
    rows = [(f"s{b}", D0 + dt.timedelta(days=i), float(xs[b, i]), float(np.sin(i) + b)) for b in range(by) for i in range(n)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "cod string, fecha_corte date, x double, y double").repartition(5), xs


def test_positions_of_one_series(spark):
    df, _ = series(spark, 500)
    got = blocks.positions(df, "fecha_corte").orderBy("fecha_corte").collect()
    assert [r["_i"] for r in got] == list(range(1, 501))
    assert blocks.positions(df.limit(0), "fecha_corte").collect() == []


@pytest.mark.parametrize("size", [7, 64, 5000])
def test_lag_sums(spark, size):
    df, xs = series(spark, 300, by=3)
    lags = [-299, -40, -1, 0, 1, 6, 7, 8, 100, 299, 300]
    x = blocks.positions(df, "fecha_corte", ["cod"])
    got = {(r["cod"], r["lag"]): (r["p"], r["q"]) for r in blocks.lag_sums(x, {"p": ("x", "x"), "q": ("x", "y")}, lags, ["cod"], size).collect()}
    for b in range(3):
        y = np.sin(np.arange(300)) + b
        for k in lags:
            if k == 300:
                assert (f"s{b}", k) not in got
                continue
            later, earlier = (slice(k, None), slice(None, 300 - k)) if k >= 0 else (slice(None, 300 + k), slice(-k, None))
            np.testing.assert_allclose(got[f"s{b}", k], (xs[b][later] @ xs[b][earlier], xs[b][later] @ y[earlier]), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("size", [16, 4096])
def test_decompose_in_blocks_is_decompose(spark, monkeypatch, size):
    df, xs = series(spark, 200)
    monkeypatch.setattr(blocks.with_borders, "__defaults__", (0, size, "_i"))
    got = stats.decompose(df, "x", trend=31).orderBy("fecha_corte").collect()
    trend = [xs[0, i - 15:i + 16].mean() if 15 <= i < 185 else None for i in range(200)]
    assert [r["trend"] is None for r in got] == [t is None for t in trend]
    np.testing.assert_allclose([r["trend"] for r in got if r["trend"] is not None], [t for t in trend if t is not None], rtol=1e-9)


def test_no_single_partition_and_no_rows_by_lags(spark):
    df, _ = series(spark, 200)
    plan = stats.acf(df, "x", range(2, 60))._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window" in x]
    assert not windows and "Join" not in plan.replace("BroadcastHashJoin", "")


def test_pivot_of_every_day(spark):
    rows = [("a", D0, 1.0), ("a", D0 + dt.timedelta(days=3), 2.0), ("a", D0 + dt.timedelta(days=4), None), ("a", D0 + dt.timedelta(days=9), 9.0),
            ("b", D0 + dt.timedelta(days=9), 4.0), ("b", D0 + dt.timedelta(days=10), 5.0), ("b", D0 - dt.timedelta(days=1), 6.0)]
    df = spark.createDataFrame(rows, "cod string, fecha_corte date, v double")
    got = {r["cod"]: [r[f"d_{i}"] for i in range(10)] for r in stats.pivot_days(df, "cod", "v", D0, 10).collect()}
    assert got == {"a": [1.0, None, None, 2.0, None, None, None, None, None, 9.0], "b": [None] * 9 + [4.0]}
