"""Clusterings fitted together: each equal to the same fit alone, scores to Spark's evaluator, consensus to the dense matrix."""

import random
import time

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMOKE
from fundlens.operators import cluster as CL
from fundlens.operators import lockstep as LS


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.4, (40, 2)) for c in ((0, 0), (4, 1), (1, 5), (6, 6))])
    df = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "cod string, map array<double>")
    ready = LS.prepare(df.repartition(5), "cod", "map").checkpoint()
    rows = ready.collect()
    return ready, np.array([r["x"] for r in rows]), np.array([r["h"] for r in rows], np.int64)


def alone(x, centres, rounds):
    """Plain Lloyd iterations."""
    for _ in range(rounds):
        label = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(axis=1)).max()
        centres = new
        if moved <= LS.MOVE:
            break
    return centres


def expectation_maximisation(x, means, covs, weights, floor, rounds):
    last = -np.inf
    for _ in range(rounds):
        p = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt((2 * np.pi) ** 2 * np.linalg.det(c))
                      for m, c, w in zip(means, covs, weights)], axis=1)
        fit = np.log(p.sum(axis=1)).mean()
        r = p / p.sum(axis=1, keepdims=True)
        means = (r.T @ x) / r.sum(axis=0)[:, None]
        covs = [np.einsum("n,ni,nj->ij", r[:, j], x - means[j], x - means[j]) / r[:, j].sum() + floor for j in range(len(means))]
        weights = r.mean(axis=0)
        if not fit - last > LS.GAIN:
            break
        last = fit
    return means, np.array(covs), weights


def test_each_fit_equals_the_same_fit_alone(cloud):
    ready, x, h = cloud
    fits = [LS.Fit(a, r, k) for a in LS.ALGORITHMS for k in (3, 5) for r in range(4)]
    start, seeds, limit = LS.start_many(ready, fits, 7, 0.8)
    begun = {id_: g for id_, (at, g) in enumerate(start.groups)}
    done = LS.fit_many(ready, fits, 7)
    for n, (at, g) in enumerate(done.groups):
        for i, f in enumerate(at):
            mine = x[LS._members(h, seeds[[f]], limit[[f]])[:, 0]]
            assert 0.6 * len(x) < len(mine) < len(x)
            if isinstance(g, LS.KMeansFits):
                np.testing.assert_allclose(g.centres[i], alone(mine, begun[n].centres[i], LS.MAX_KMEANS), atol=1e-9)
            elif isinstance(g, LS.MixtureFits):
                b = begun[n]
                means, covs, weights = expectation_maximisation(mine, b.means[i], b.covs[i], b.weights[i], b.floor, LS.MAX_GMM)
                np.testing.assert_allclose(g.means[i], means, atol=1e-7)
                np.testing.assert_allclose(g.covs[i], covs, atol=1e-7)
                np.testing.assert_allclose(g.weights[i], weights, atol=1e-7)
            else:
                # every split is a converged two-means of the points that reach it
                node = g._nodes(mine, [i])[:, 0]
                below = lambda t: [t] if g.child[i, t] < 0 else [u for s in (0, 1) for u in below(g.child[i, t] + s)]
                assert g.count[i] == 2 * fits[f].k - 1
                for t in range(g.count[i]):
                    if g.child[i, t] >= 0:
                        inside = mine[np.isin(node, below(t))]
                        pair = g.centres[i, g.child[i, t]:g.child[i, t] + 2]
                        np.testing.assert_allclose(pair, alone(inside, pair, 1), atol=1e-6)
    labels = done.labels(x)
    assert all(set(labels[:, i]) <= set(range(f.k)) for i, f in enumerate(fits))


def test_a_fit_does_not_depend_on_the_others(cloud):
    ready, x, _ = cloud
    many = LS.fit_many(ready, [LS.Fit(a, r, 4) for a in LS.ALGORITHMS for r in range(3)], 7)
    for at, f in enumerate(many.fits):
        one = LS.fit_many(ready.repartition(2), [f], 7)
        assert (one.labels(x)[:, 0] == many.labels(x)[:, at]).all()


def test_silhouettes_equal_the_evaluator(spark, cloud):
    ready, x, _ = cloud
    rnd = random.Random(3)
    rows = ready.select("cod", "x").collect()
    parts = [[i % 4 for i in range(len(rows))], [rnd.randrange(3) for _ in rows], [0] * len(rows), [int(i == 0) for i in range(len(rows))]]
    df = spark.createDataFrame([(r["cod"], r["x"], [p[i] for p in parts]) for i, r in enumerate(rows)], "cod string, x array<double>, clusters array<int>")
    got = LS.silhouettes(df.repartition(3), [4, 3, 2, 2])
    assert got[2] is None
    for i in (0, 1, 3):
        flat = df.select(array_to_vector("x").alias("features"), F.col("clusters")[i].alias("prediction"))
        assert got[i] == pytest.approx(ClusteringEvaluator().evaluate(flat), abs=1e-9)


@pytest.mark.parametrize("seed", range(3))
def test_consensus_equals_the_dense_matrix(spark, seed):
    """Planted blocks behind noisy labels: the blocks of the co-association matrix, as its dense eigenvectors give them."""
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 4, 120)
    labels = []
    for _ in range(25):
        turn = rng.permutation(4)[truth]
        noisy = rng.random(120) < 0.2
        labels.append(np.where(noisy, rng.integers(0, 4, 120), turn))
    labels = np.array(labels).T
    df = spark.createDataFrame([(f"f{i:03d}", row.tolist()) for i, row in enumerate(labels)], "cod string, labels array<int>")
    got = LS.partition_many(df, LS.consensus_many(df.repartition(3), [range(25), range(0, 25, 2)], [4, 4], seed)).collect()
    for s, runs in enumerate((slice(None), slice(0, None, 2))):
        mine = {r["cod"]: r["clusters"][s] for r in got}
        mine = np.array([mine[f"f{i:03d}"] for i in range(120)])
        one_hot = (labels[:, runs, None] == np.arange(4)).reshape(120, -1).astype(float)
        similar = one_hot @ one_hot.T
        root = np.sqrt(similar.sum(axis=1))
        _, vectors = np.linalg.eigh(similar / root[:, None] / root)
        rows = vectors[:, -4:] / root[:, None]
        dense = min((alone(rows, LS.plus_plus(rows, 4, np.random.default_rng(t)), 50) for t in range(10)),
                    key=lambda c: ((rows[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum())
        dense = ((rows[:, None] - dense) ** 2).sum(axis=2).argmin(axis=1)
        assert (truth[:, None] == truth).astype(int).tolist() == (mine[:, None] == mine).astype(int).tolist()
        assert (dense[:, None] == dense).astype(int).tolist() == (mine[:, None] == mine).astype(int).tolist()


def test_equal_points_and_more_components_than_groups(spark):
    df = spark.createDataFrame([(f"p{i}", [float(i % 2), 0.0]) for i in range(12)], "cod string, map array<double>")
    labels = CL.member_labels(df, 4, reps=3)
    assert labels.count() == 12 * 9 and labels.where("label IS NULL OR label < 0 OR label > 3").isEmpty()
    assert CL.consensus_cluster(labels, 4).where("cluster IS NULL").isEmpty()


@pytest.mark.parametrize("name", ["silhouette_sweep", "cluster_assignment", "cluster_bands", "cluster_peers_models"])
def test_the_sweep_ends_in_time(spark, name):
    begun = time.time()
    rows = E.queries()[name](spark, SMOKE).collect()
    assert time.time() - begun < 240
    assert name != "silhouette_sweep" or len(rows) == 21


def test_co_association_with_every_other_fund(spark):
    labels = spark.createDataFrame([("a", "r0", 0), ("b", "r0", 0), ("c", "r0", 1), ("a", "r1", 2), ("b", "r1", 1), ("a", "r2", 0), ("c", "r2", 0)],
                                   "cod string, run string, label int")
    assert {(r["cod"], r["co_association"], r["runs"]) for r in CL.co_association(labels, "a").collect()} == {("b", 0.5, 2), ("c", 0.5, 2)}


def test_passes_start_a_task_for_some_hundred_points(spark, monkeypatch):
    """Points that come in a partition per bucket are dealt anew, and the consensus' k-means reads rows that are written once."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (4, 1), (1, 5))])
    df = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "cod string, map array<double>").repartition(40)
    asked = []
    summed = LS.summed

    def spy(rows, part, size):
        asked.append((rows.rdd.getNumPartitions(), rows.columns))
        return summed(rows, part, size)

    monkeypatch.setattr(LS, "summed", spy)
    grid = spark.createDataFrame([(1, "kmeans", 3), (2, "kmeans+bisecting", 3)], "subset int, algorithms string, k int")
    scores, clusters = CL.sweep_partitions(df, grid, reps=3)
    assert {n for n, _ in asked} == {1}
    assert sum("labels" in columns for _, columns in asked) == LS.STEPS + 2      # the degrees and the steps; k-means reads written rows
    found = clusters.join(df, "cod").collect()
    assert len(found) == 90 and len({(r["clusters"][0], r["cod"] < "p030", r["cod"] < "p060") for r in found}) == 3
    assert scores.where("silhouette > 0.8").count() == 2
    monkeypatch.setattr(LS, "LEAST_POINTS", 30)
    assert LS.dealt(df, 90).rdd.getNumPartitions() == 3
