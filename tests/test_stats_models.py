"""Diagnostics against numpy brute force; model-output invariants."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.operators import cluster as CL
from fundlens.operators import forecast as FC
from fundlens.operators import stats as ST
from fundlens.plans.queries_stats import parameter_grid

D = dt.date


def _index(spark, n=200, seed=3):
    rnd = random.Random(seed)
    vals = [math.sin(i / 3.0) * 0.001 + rnd.gauss(0, 0.0005) for i in range(n)]
    rows = [(D(2018, 1, 1) + dt.timedelta(days=i), v, 100 + i * 0.1 + rnd.random(), 50 + rnd.random())
            for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "fecha_corte date, v double, trm double, ipc double"), np.array(vals)


def test_acf_matches_numpy(spark):
    df, x = _index(spark)
    got = {r["lag"]: r["acf"] for r in ST.acf(df, "v", [0, 1, 2, 7, 30]).collect()}
    d = x - x.mean()
    den = (d * d).sum()
    for k in (0, 1, 2, 7, 30):
        assert got[k] == pytest.approx((d[:len(d) - k] * d[k:]).sum() / den, rel=1e-9)
    assert got[0] == pytest.approx(1.0)


def test_acf_by_group(spark):
    df, x = _index(spark)
    two = df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")))
    got = ST.acf(two, "v", [1, 5], by=["g"]).collect()
    assert len(got) == 4 and len({round(r["acf"], 12) for r in got}) == 2


def test_ccf_matches_numpy(spark):
    df, x = _index(spark)
    pdf = df.toPandas().sort_values("fecha_corte")
    y = pdf["trm"].to_numpy()
    got = {(r["lag"], r["variable"]): r["ccf"] for r in ST.ccf(df, "v", ["trm", "ipc"], [0, 3]).collect()}
    n = len(x)
    for k in (0, 3):
        want = ((x[k:] - x.mean()) * (y[:n - k] - y.mean())).sum() / n / (x.std() * y.std())
        assert got[(k, "trm")] == pytest.approx(want, rel=1e-9)


def test_decompose_season_centred(spark):
    df, _ = _index(spark)
    out = ST.decompose(df, "v", period=7, trend=15)
    seasons = {r["season"] for r in out.collect()}
    assert len(seasons) == 7 and abs(sum(seasons)) < 1e-15
    r = out.where("trend IS NOT NULL").first()
    assert r["observed"] == pytest.approx(r["trend"] + r["season"] + r["remainder"])


def test_quantile_band_monotone_and_profile(spark):
    df, _ = _index(spark)
    b = ST.quantile_band(df.withColumn("k", F.month("fecha_corte")), ["k"], "v").collect()
    assert all(r["q1"] <= r["q2"] <= r["q3"] for r in b)
    prof = ST.seasonal_profile(df, "v", "wday.lbl").collect()
    assert len(prof) == 7 and all(r["min"] <= r["q25"] <= r["median"] <= r["q75"] <= r["max"] for r in prof)


def test_standardize(spark):
    df, x = _index(spark)
    z = FC.standardize(df, ["v"]).agg(F.avg("v"), F.stddev_samp("v")).first()
    assert abs(z[0]) < 1e-12 and z[1] == pytest.approx(1.0)


def _panel(spark, funds=6, days=500, seed=11):
    rnd = random.Random(seed)
    rows = []
    for f in range(funds):
        level = rnd.uniform(-0.0005, 0.0005)
        for i in range(days):
            d = D(2018, 1, 1) + dt.timedelta(days=i)
            g = level + 0.0004 * math.sin(2 * math.pi * d.weekday() / 7) + rnd.gauss(0, 0.0002)
            rows.append((f"f{f}", d, g, 1.0 + 0.001 * i, 2.0 + 0.0001 * i, float(d.weekday() >= 5)))
    return spark.createDataFrame(rows, "cod string, fecha_corte date, creci_dia double, trm double, ipc double, "
                                       "dia_no_habil double")


def test_cv_plan_folds(spark):
    ds = _panel(spark)
    plan = FC.cv_plan(ds, 28, 28, 13)
    ass = plan.where("role = 'assessment'").groupBy("fold").agg(F.min("fecha_corte").alias("a"),
                                                                 F.max("fecha_corte").alias("b")).collect()
    assert len(ass) == 13
    spans = sorted((r["a"], r["b"]) for r in ass)
    assert all((b - a).days == 27 for a, b in spans)
    assert all(spans[i][1] < spans[i + 1][0] for i in range(len(spans) - 1))     # disjoint
    bad = plan.groupBy("fold").agg(F.max(F.when(F.col("role") == "analysis", F.col("fecha_corte"))).alias("ta"),
                                   F.min(F.when(F.col("role") == "assessment", F.col("fecha_corte"))).alias("sa"))
    assert bad.where("ta >= sa").count() == 0                                    # no leakage


def test_holdout_split(spark):
    ds = _panel(spark)
    train, test = FC.holdout_split(ds, 28)
    assert test.select("fecha_corte").distinct().count() == 28
    assert train.agg(F.max("fecha_corte")).first()[0] < test.agg(F.min("fecha_corte")).first()[0]
    assert train.count() + test.count() == ds.count()


def test_backtest_one_pass_equals_spark_ml(spark):
    ds = _panel(spark)
    bt = FC.backtest(ds, 3, kind="linear").checkpoint()
    feats, cols = FC.model_features(ds, FC.DIRECT_LAGS)
    for k, start, end in FC.fold_bounds(feats, 3):
        model = FC.fit_direct(feats.where(F.col("fecha_corte") < F.lit(start)), cols, "linear")
        ref = model.transform(feats.where(F.col("fecha_corte").between(start, end))).select(
            "cod", "fecha_corte", F.col("mean").alias("ref"))
        j = bt.where((F.col("model") == "direct_linear") & (F.col("fold") == k)).join(ref, ["cod", "fecha_corte"])
        assert j.count() == 6 * 28
        assert j.agg(F.max(F.abs(F.col("mean") - F.col("ref")))).first()[0] < 1e-9
    naive = bt.where("model = 'seasonal_naive'")
    assert naive.where("mean IS NULL").count() == 0 and naive.count() == 3 * 6 * 28


def test_forecasts_and_quantiles(spark):
    ds = FC.extend_future(_panel(spark).select("cod", "fecha_corte", "creci_dia"), 28)
    ds = ds.join(_panel(spark).select("fecha_corte", "trm", "ipc", "dia_no_habil").distinct(), "fecha_corte", "left")
    rec = FC.forecast_recursive(ds)
    assert rec.groupBy("cod").count().where("count = 28").count() == 6
    assert rec.where("mean IS NULL OR isnan(mean)").count() == 0
    feats, cols = FC.model_features(ds, FC.DIRECT_LAGS)
    model = FC.fit_direct(feats, cols, "linear")
    pred = FC.predict(model, feats.where("creci_dia IS NULL"))
    res = FC.backtest(ds, 4, kind="linear").where("model = 'direct_linear'")
    q = FC.forecast_quantiles(pred, res).collect()
    names = [f"q{int(round(lv * 100)):02d}" for lv in FC.QUANTILE_LEVELS]
    assert len(q) == 6 * 28
    assert all(all(r[a] <= r[b] for a, b in zip(names, names[1:])) for r in q)


def test_model_store_round_trip(spark, tmp_path):
    ds = _panel(spark)
    feats, cols = FC.model_features(ds, FC.DIRECT_LAGS)
    model = FC.fit_direct(feats, cols, "linear")
    FC.save_model(model, str(tmp_path / "m"))
    a = FC.predict(model, feats).orderBy("cod", "fecha_corte").collect()
    b = FC.predict(FC.load_model(str(tmp_path / "m")), feats).orderBy("cod", "fecha_corte").collect()
    assert [r["mean"] for r in a] == [r["mean"] for r in b]


def test_seasonal_naive_future(spark):
    rows = _panel(spark, funds=1, days=30)
    fut = FC.seasonal_naive_future(rows).orderBy("fecha_corte").collect()
    hist = {r["fecha_corte"]: r["creci_dia"] for r in rows.collect()}
    last = max(hist)
    assert len(fut) == 28
    for i, r in enumerate(fut):
        assert r["mean"] == hist[last - dt.timedelta(days=6 - i % 7)]


def test_vote_vectors_are_co_association(spark):
    labels = spark.createDataFrame([
        ("a", "r0", 0), ("b", "r0", 0), ("c", "r0", 1),
        ("a", "r1", 2), ("b", "r1", 1), ("c", "r1", 1),
        ("a", "r2", 0), ("c", "r2", 0),
    ], "cod string, run string, label int")
    votes = {r["cod"]: np.array(r["votes"].toArray()) for r in CL.label_vectors(labels, 3).collect()}
    lab = {(r["cod"], r["run"]): r["label"] for r in labels.collect()}
    for x in "abc":
        for y in "abc":
            same = sum(1 for run in ("r0", "r1", "r2")
                       if (x, run) in lab and (y, run) in lab and lab[(x, run)] == lab[(y, run)])
            assert votes[x] @ votes[y] == same
    ca = CL.co_association(labels, "a", "b").first()
    assert ca["runs"] == 2 and ca["co_association"] == 0.5


def _blocks(spark, funds, days=60):
    rnd = random.Random(5)
    rows = []
    for f in range(funds):
        centre = (f % 3) * 0.01
        for i in range(days):
            rows.append((f"f{f:03d}", D(2020, 1, 1) + dt.timedelta(days=i), centre + rnd.gauss(0, 0.001)))
    return spark.createDataFrame(rows, "cod string, fecha_corte date, crecimiento_dia double")


def test_cluster_pipeline(spark):
    vecs = CL.fund_vectors(_blocks(spark, 12))
    assert vecs.count() == 12 and {r["n"] for r in vecs.collect()} == {60}
    pts = CL.embed_2d(vecs).checkpoint()
    labels = CL.member_labels(pts, 3, reps=2)
    cons = CL.consensus_cluster(labels, 3).collect()
    assert len(cons) == 12
    groups = {}
    for r in cons:
        groups.setdefault(int(r["cod"][1:]) % 3, set()).add(r["cluster"])
    assert all(len(v) == 1 for v in groups.values())         # planted blocks recovered
    sweep = CL.silhouette_sweep(pts, parameter_grid(spark, ks=(3, 40)), reps=2).collect()
    assert len(sweep) == 14 and [r["n"] for r in sweep] == list(range(1, 15))
    assert all(-1 <= r["silhouette"] <= 1 if r["k"] == 3 else r["silhouette"] is None for r in sweep)


def test_every_fund_gets_a_label_however_rows_are_partitioned(spark):
    pts = CL.embed_2d(CL.fund_vectors(_blocks(spark, 240, days=12))).checkpoint()
    seen = []
    for parts in (1, 64):
        labels = CL.member_labels(pts.repartition(parts), 5, algorithms=("kmeans",), reps=3)
        got = CL.consensus_cluster(labels, 5)
        assert got.count() == got.select("cod").distinct().count() == 240
        assert got.where("cluster IS NULL").isEmpty()
        assert labels.where("label IS NULL").isEmpty() and labels.count() == 240 * 3
        seen.append({r["run"]: r["n"] for r in labels.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()})
    assert seen[0] == seen[1]


def test_too_few_funds_give_null_labels(spark):
    pts = CL.embed_2d(CL.fund_vectors(_blocks(spark, 4))).checkpoint()
    labels = CL.member_labels(pts, 4, reps=2)
    assert labels.count() == 4 * 6 and labels.where("label IS NOT NULL").isEmpty()
    assert [r["cluster"] for r in CL.consensus_cluster(labels, 4).collect()] == [None] * 4


def test_naive_control_reads_nothing_from_its_window(spark):
    rows = _panel(spark, funds=2, days=90)
    last = rows.agg(F.max("fecha_corte")).first()[0]
    start = last - dt.timedelta(days=27)
    hidden = rows.where(F.col("fecha_corte") < F.lit(start)).unionByName(
        rows.where(F.col("fecha_corte") >= F.lit(start)).withColumn("creci_dia", F.lit(99.0)))
    for lag in (1, 7):
        a = {(r["cod"], r["fecha_corte"]): r["mean"] for r in FC.seasonal_naive(rows, start, lag=lag).collect()}
        b = {(r["cod"], r["fecha_corte"]): r["mean"] for r in FC.seasonal_naive(hidden, start, lag=lag).collect()}
        assert a == b and len(a) == 2 * 28
    res = FC.naive_residuals(rows, start, folds=2).count()
    assert res == FC.naive_residuals(hidden, start, folds=2).count() == 2 * 52      # the oldest window lacks one day of the week before it
    bands = FC.residual_bands(FC.seasonal_naive(rows, start), FC.naive_residuals(rows, start, folds=2)).collect()
    assert all(r["q05"] <= r["q25"] <= r["q75"] <= r["q95"] for r in bands)


def test_recursive_forecast_equals_a_plain_loop(spark):
    ds = FC.extend_future(_panel(spark).select("cod", "fecha_corte", "creci_dia"), 28)
    ds = ds.join(_panel(spark).select("fecha_corte", "trm", "ipc", "dia_no_habil").distinct(), "fecha_corte", "left")
    feats, cols = FC.model_features(ds, FC.RECURSIVE_LAGS)
    lr = FC.fit_recursive(feats, cols).stages[-1]
    coef = dict(zip(cols, lr.coefficients))
    got = {(r["cod"], r["fecha_corte"]): r["mean"] for r in FC.forecast_recursive(ds).collect()}
    by_fund = {}
    for r in ds.orderBy("fecha_corte").collect():
        by_fund.setdefault(r["cod"], []).append(r)
    assert len(got) == 28 * len(by_fund)
    for cod, rows in by_fund.items():
        values = [r["creci_dia"] for r in rows if r["creci_dia"] is not None]
        n = len(values)
        for i, r in enumerate(r for r in rows if r["creci_dia"] is None):
            d = r["fecha_corte"]
            x = {"day_of_week": d.weekday(), "day_of_month": d.day, "day_of_year": d.timetuple().tm_yday,
                 "age": np.log10(2.0 + n + i), **{c: r[c] or 0.0 for c in FC.COVARIATES},
                 **{f"lag_{k}": values[-k] if len(values) >= k else 0.0 for k in FC.RECURSIVE_LAGS}}
            values.append(lr.intercept + sum(coef[c] * x[c] for c in cols))
            assert got[cod, d] == pytest.approx(values[-1], rel=1e-9, abs=1e-12)


def test_constant_series_gives_null_not_error(spark):
    rows = [(D(2020, 1, 1) + dt.timedelta(days=i), 1.0, 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "fecha_corte date, v double, w double")
    assert FC.standardize(df, ["v"]).first()["v"] is None
    assert ST.acf(df, "v", [1]).first()["acf"] is None
    assert ST.ccf(df, "v", ["w"], [0]).first()["ccf"] is None


def test_recursive_windows_in_one_pass_equal_one_window_at_a_time(spark):
    rnd = random.Random(12)
    days = 200
    rows = [(f"f{f}", D(2021, 1, 1) + dt.timedelta(days=i), rnd.gauss(0, 1) + (i % 7) * 0.1, rnd.gauss(0, 1), float(i % 30), float(i % 7 > 4))
            for f in range(4) for i in range(0 if f < 3 else 90, days - (10 if f == 2 else 0))]
    ds = spark.createDataFrame(rows, "cod string, fecha_corte date, creci_dia double, trm double, ipc double, dia_no_habil double").checkpoint()
    got = {(r["fold"], r["cod"], r["fecha_corte"]): r for r in FC.backtest(ds, 3, 28, "recursive").collect()}
    want = 0
    for k, start, _ in FC.fold_bounds(ds, 3, 28, 28):
        alone = FC.forecast_recursive(FC.masked(ds, start, 28), 28)
        for r in alone.join(ds, ["cod", "fecha_corte"]).collect():
            mine = got[k, r["cod"], r["fecha_corte"]]
            assert mine["mean"] == pytest.approx(r["mean"], abs=1e-9) and mine["actual"] == r["creci_dia"]
            assert mine["h"] == (r["fecha_corte"] - start).days + 1
            want += 1
    assert want == len(got) > 200
