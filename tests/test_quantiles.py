"""Distributed selection against Spark's ``percentile``, bit for bit."""

import random

import pytest
from pyspark.sql import functions as F

from fundlens.operators.quantiles import exact_quantiles, quantile_rounds

QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.999, 1.0]


def values(kind, n, rnd):
    return {"normal": lambda: rnd.gauss(0, 1), "tied": lambda: rnd.choice([0.0, 1.0, 1.0, 2.5]),
            "heavy": lambda: rnd.choice([3.0, rnd.paretovariate(0.3) ** 8, -rnd.paretovariate(0.2)]),
            "one": lambda: 7.0, "tiny": lambda: rnd.random() * 1e-300}[kind] if n else None


@pytest.mark.parametrize("limit", [10, 300])
def test_equal_to_percentile(spark, limit):
    rnd = random.Random(limit)
    rows = []
    for kind in ("normal", "tied", "heavy", "one", "tiny"):
        draw = values(kind, 1, rnd)
        rows += [(kind, 1, draw()) for _ in range(rnd.choice([2500, 3001]))]
    rows += [("few", 2, 1.0), ("few", 2, 4.0), ("none", 3, None), (None, None, None), *[(None, None, rnd.random()) for _ in range(900)]]
    rows += [("normal", 1, None)] * 50 + [("normal", 2, float("inf")), ("normal", 2, float("-inf"))]
    df = spark.createDataFrame(rows, "k string, j int, x double").repartition(6)
    want = {(r["k"], r["j"]): r["q"] for r in df.groupBy("k", "j").agg(F.percentile("x", QS).alias("q")).collect()}
    got = {(r["k"], r["j"]): r["_q"] for r in exact_quantiles(df, ["k", "j"], "x", QS, limit=limit).collect()}
    assert {k: repr(v) for k, v in got.items()} == {k: repr(v) for k, v in want.items()}      # NaN included
    assert repr(exact_quantiles(df, [], "x", QS, limit=limit).first()["_q"]) == repr(df.agg(F.percentile("x", QS)).first()[0])


def test_empty(spark):
    df = spark.createDataFrame([], "k string, x double")
    assert exact_quantiles(df, ["k"], "x", QS).collect() == []
    assert exact_quantiles(df, [], "x", QS).first()["_q"] is None


def test_rounds_grow_with_the_logarithm():
    assert quantile_rounds(1000) == 0 and quantile_rounds(10 ** 12) <= 4
