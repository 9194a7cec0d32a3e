"""Boosted folds grown together against plain numpy and against each fold alone."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from fundlens.operators import boosting as B


def plain(codes, y, bins, trees, depth):
    """One model, row by row; predictions of its training rows."""
    now = np.full(len(y), y.mean())
    for number in range(trees):
        r = y - now
        step = B.STEP if number else 1.0
        add = np.zeros(len(y))

        def grow(rows, level, value):
            best = None
            if level < depth and len(rows) >= 2:
                for f in range(codes.shape[1]):
                    for b in range(bins - 1):
                        left = codes[rows, f] <= b
                        if 0 < left.sum() < len(rows):
                            gain = r[rows[left]].sum() ** 2 / left.sum() + r[rows[~left]].sum() ** 2 / (~left).sum() - r[rows].sum() ** 2 / len(rows)
                            if best is None or gain > best[0] + 1e-12:
                                best = gain, f, b
            if best is None or best[0] <= 1e-9:
                add[rows] = value
                return
            _, f, b = best
            left = codes[rows, f] <= b
            for part in (rows[left], rows[~left]):
                grow(part, level + 1, step * r[part].mean())

        grow(np.arange(len(y)), 0, 0.0)
        now = now + add
    return now


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 3)), 2)
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + x[:, 1] * x[:, 2] + 0.1 * rng.normal(size=240)
    b = rng.integers(0, 4, 240)
    df = spark.createDataFrame([(v.tolist(), float(t), int(k)) for v, t, k in zip(x, y, b)], "x array<double>, y double, b int").repartition(4)
    return df, x, y, b


def test_folds_equal_a_plain_fit(data):
    df, x, y, b = data
    edges = B.feature_edges(df, 3, 8)
    codes = B.bin_codes(x, edges)
    models = B.fit_folds(df, 3, edges, trees=5, depth=3, write_every=2)
    for k, m in enumerate(models, 1):
        mine = b >= k
        np.testing.assert_allclose(m.predict(codes[mine]), plain(codes[mine], y[mine], 8, 5, 3), atol=1e-8)
        assert np.mean((m.predict(codes[mine]) - y[mine]) ** 2) < 0.6 * np.var(y[mine])


def test_a_fold_equals_the_same_fold_alone(data):
    df, x, _, _ = data
    edges = B.feature_edges(df, 3)
    codes = B.bin_codes(x, edges)
    together = B.fit_folds(df, 3, edges, trees=4)
    alone = B.fit_folds(df.withColumn("b", (F.col("b") >= 2).cast("int")).repartition(2), 1, edges, trees=4)
    np.testing.assert_allclose(together[1].predict(codes), alone[0].predict(codes), atol=1e-9)


def test_pipeline_and_folds_predict_alike(spark, data, tmp_path):
    df, x, _, _ = data
    edges = B.feature_edges(df, 3)
    models = B.fit_folds(df, 2, edges, trees=3)
    rows = df.withColumn("fold", F.lit(2)).withColumns({f"c{j}": F.col("x")[j] for j in range(3)})
    B.as_pipeline(models[1], ["c0", "c1", "c2"], "sql").write().save(str(tmp_path / "m"))
    both = B.predict_folds(PipelineModel.load(str(tmp_path / "m")).transform(rows), models).collect()
    assert len(both) == 240
    np.testing.assert_allclose([r["mean"] for r in both], [r["sql"] for r in both], atol=1e-12)


def test_few_rows(spark):
    df = spark.createDataFrame([([1.0, float("nan")], 3.0, 1), ([1.0, 2.0], None, 1)], "x array<double>, y double, b int")
    one, none = B.fit_folds(df, 2, B.feature_edges(df, 2), trees=2)
    assert one.predict(np.zeros((1, 2), int))[0] == 3.0 and none.predict(np.zeros((1, 2), int))[0] == 0.0


def test_passes_take_the_smaller_sides_of_few_tasks(data, monkeypatch):
    df, _, _, _ = data
    asked = []
    summed = B.summed

    def spy(rows, part, size):
        asked.append((rows.rdd.getNumPartitions(), size))
        return summed(rows, part, size)

    monkeypatch.setattr(B, "summed", spy)
    edges = B.feature_edges(df, 3, 8)
    B.fit_folds(df, 3, edges, trees=2, depth=3)
    width = max(len(e) for e in edges) + 1
    node = 3 * width * 2
    # a level asks for at most one histogram per split of the level above: 1, 1 and 2 nodes a fold, not 1, 2 and 4
    assert [size // node // 3 for _, size in asked[1:]] == [1, 1, 2] * 2
    # 240 rows are one task's work, and more rows are dealt by their number
    assert {n for n, _ in asked} == {1}
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    asked.clear()
    B.fit_folds(df, 3, edges, trees=1, depth=1)
    assert asked[0][0] == 4


def test_a_task_a_fold_equals_passes(data, monkeypatch):
    df, x, _, b = data
    edges = B.feature_edges(df, 3, 8)
    codes = B.bin_codes(x, edges)
    passes = B.fit_folds(df, 3, edges, trees=5, depth=3, write_every=2)
    monkeypatch.setattr(B, "summed", lambda *_: pytest.fail("a pass over rows that one task can hold"))
    alone = B.grow_folds(df, 3, edges, trees=5, depth=3)
    monkeypatch.undo()
    monkeypatch.setattr(B, "MEMORY_ROWS", 10)
    read = B.grow_folds(df, 3, edges, trees=5, depth=3)
    for k, (one, two, three) in enumerate(zip(passes, alone, read), 1):
        np.testing.assert_allclose(one.predict(codes[b >= k]), two.predict(codes[b >= k]), atol=1e-9)
        np.testing.assert_allclose(one.predict(codes), three.predict(codes), atol=1e-9)


def test_equal_rows_are_one_group(data):
    """Rows that fall into the same bins are read once, wherever they lie; those of other folds are not mixed in."""
    df, x, y, b = data
    edges = B.feature_edges(df, 3, 4)
    many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(7)))).drop("copy").repartition(6)
    blocks, groups = B.pack(many, 2, edges)
    want = {}
    for code, t, k in zip(B.bin_codes(x, edges).tolist(), y, np.minimum(b, 2)):
        if k:
            held = want.setdefault((*code, int(k)), [0.0, 0])
            held[0], held[1] = held[0] + 7 * t, held[1] + 7
    got = {}
    for r in blocks.collect():
        codes = np.frombuffer(r["codes"], np.uint8).reshape(3, r["m"]).T.tolist()
        for code, k, t, n in zip(codes, *(np.frombuffer(r[c], t) for c, t in (("b", np.int32), ("y", float), ("n", float)))):
            assert (*code, int(k)) not in got
            got[*code, int(k)] = t, n
    assert groups == len(got) < 240 and got.keys() == want.keys()
    for key, (t, n) in got.items():
        assert n == want[key][1] and t == pytest.approx(want[key][0], abs=1e-9)


def test_edges_of_many_rows_are_exact_and_do_not_depend_on_the_partitions(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=4000), np.where(rng.random(4000) < 0.05, rng.normal(size=4000), 0.0), rng.exponential(1e6, 4000)], axis=1)
    x[0], x[1] = [np.nan, -0.0, np.inf], [-np.inf, np.nan, 0.0]
    data = [(v.tolist(),) for v in x]
    data[2][0][2] = None
    df = spark.createDataFrame(data, "x array<double>")
    want = [np.unique([v[max(1, -(-i * len(v) // 32)) - 1] for i in range(1, 32)]) for v in (np.sort([r[j] for (r,) in data if r[j] is not None]) for j in range(3))]
    for n, most in ((1, 0), (7, 0), (7, 1 << 20)):                          # 4,000 rows: sketches are exact as well
        monkeypatch.setattr(B, "SKETCH_ROWS", most)
        got = B.feature_edges(df.repartition(n), 3)
        assert all(np.array_equal(a, c, equal_nan=True) for a, c in zip(got, want))
