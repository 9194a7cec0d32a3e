"""Hard negatives against plain Python, and the threshold algorithm on its own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import negatives


def brute(rows, low=50, high=95, scale=256):
    ok = [(i, y, tuple(math.floor(scale * x) for x in v)) for i, v, y in rows
          if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, y, q in {r for r in ok if r[0] % 50 == 0}:
        pairs = [(-sum(s * t for s, t in zip(q, v)), i, z) for i, z, v in ok if i != a and len(v) == len(q)]
        pairs = sorted(p for p in pairs if abs(p[0]) < 1 << 63)
        for ps, p, _ in [r for r in pairs if r[2] == y][:5]:
            hits = [(s, n) for s, n, z in pairs if z != y and low * -ps <= 100 * -s <= high * -ps][:3]
            out += [(a, p, rank, n, -ps, -s) for rank, (s, n) in enumerate(hits, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 18, 9])
def test_hard_negatives(spark, block):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(12)], rnd.choice([1, 1, 2, 3])) for i in range(260)]
    rows += [(i, rows[7][1], rnd.choice([1, 2])) for i in range(300, 340)]                 # ties
    rows += [(7, rows[7][1], rows[7][2])] * 2 + [(50, rows[50][1], rows[50][2])]           # repeated rows
    rows += [(100, rows[101][1], 9), (102, rows[101][1], 9)]                               # an id with two rows
    rows += [(400, None, 1), (401, [1.0, None], 1), (450, [float("nan")] * 12, 1), (451, [float("inf")] * 12, 2), (None, rows[0][1], 1),
             (452, rows[0][1], None), (500, [0.5, 0.25], 1), (501, [0.5, 0.5], 1), (502, [0.25, 0.5], 2), (550, [], 1), (551, [], 1),
             (552, [], 2), (600, [0.0] * 12, 1), (650, [1e30] * 2, 1), (651, [1e30] * 2, 1), (652, [3e7] * 2, 1), (653, [2e7] * 2, 2),
             (654, [0.0, 1e-3], 2), (700, [2.0 ** 22] * 2, 4), (701, [2.0 ** 22] * 2, 4), (702, [2.0 ** 21, 2.0 ** 21 + 1], 2)]
    df = spark.createDataFrame([(i, v, y, 5, "s") for i, v, y in rows], "vec_id long, embedding array<double>, label int, rank int, `score` string")
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, block=block).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_threshold_search(seed):
    """Equal to scoring every row; stops early where few dimensions carry the scores."""
    rng = np.random.default_rng(seed)
    x = np.floor(256 * rng.normal(0, 1, (3000, 8)) * 0.5 ** np.arange(8))
    a = np.floor(256 * rng.normal(0, 1, 8) * 0.5 ** np.arange(8))
    fits = rng.random(3000) < 0.7
    scores = x @ a
    top = np.sort(scores[fits])[-1]
    windows = [(-1 << 62, 1 << 62), (top / 2, 0.95 * top), (top / 2, top / 2 - 1), (2 * top, 3 * top)]
    found, touched = negatives.threshold_search(a, x, negatives.sorted_lists(x), fits, windows, 3)
    for (low, high), (rows, got) in zip(windows, found):
        inside = np.flatnonzero(fits & (scores >= low) & (scores <= high))
        want = sorted(((-scores[r], r) for r in inside))[:3]
        assert sorted(zip((-got).tolist(), rows.tolist()))[:3] == [(s, r) for s, r in want]
    assert touched < fits.sum()


def test_exact_types():
    assert negatives.exact_type(np.ones((1, 4)), np.ones((3, 4))) is np.float32
    assert negatives.exact_type(np.full((1, 4), 2.0 ** 20), np.full((3, 4), 2.0 ** 20)) is np.float64
    assert negatives.exact_type(np.full((1, 4), 1e200), np.full((3, 4), 1e200)) is object
