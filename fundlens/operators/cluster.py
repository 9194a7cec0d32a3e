"""Behavioural clustering of funds as Spark jobs.

* ``fund_vectors``: one date-ordered vector of standardised daily growth per
  fund (``array_sort(collect_list(struct))`` -> ``array_to_vector``); a
  fund's list is bounded by its days in the window.
* ``embed_2d``: 2-d map of the funds (PCA).
* ``member_arrays`` / ``member_labels``: base clusterings (k-means, Gaussian
  mixture, bisecting k-means) over repetitions, all fitted in lockstep
  (``lockstep``); each is fitted on a hash subsample and labels every fund.
  Wide: one array of labels per fund; long: ``(cod, algorithm, k, run, label)``.
* ``consensus_cluster``: partition of the co-association similarity (share of
  runs in which two funds agree) by its leading eigenvectors, without a fund
  pair.
* ``silhouette_sweep``: every (algorithm subset, k) of the grid, scored by the
  squared-Euclidean silhouette on the 2-d map; ``best_config`` picks the winner.

``k`` is never changed: with fewer than ``k + 1`` funds there is no
clustering, and labels and scores are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.operators import lockstep as LS

SEED = 4981
ALGORITHMS = LS.ALGORITHMS


def fund_vectors(df: DataFrame, col: str = "crecimiento_dia", key: str = "cod",
                 dc: str = "fecha_corte") -> DataFrame:
    """``(cod, n, features)``: date-ordered values per fund, only funds with
    the full (maximum) length, so all vectors have one dimension per day."""
    arr = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(dc, col))).alias("_pts"))
    arr = arr.select(key, F.transform("_pts", lambda p: p[col].cast("double")).alias("_v"))
    arr = arr.withColumn("n", F.size("_v"))
    arr = arr.where(F.col("n") == arr.agg(F.max("n")).scalar())
    return arr.select(key, "n", array_to_vector("_v").alias("features"))


def embed_2d(vecs: DataFrame, key: str = "cod", k: int = 2) -> DataFrame:
    """``(cod, x, y, map)``: principal-component map of the fund vectors.

    With ``k`` or fewer funds there is no spread to project: all sit at 0.
    """
    if vecs.count() <= k:
        zero = array_to_vector(F.array(*[F.lit(0.0)] * k))
        out = vecs.select(key, zero.alias("map"))
    else:
        model = PCA(k=k, inputCol="features", outputCol="map").fit(vecs)
        out = model.transform(vecs).select(key, "map")
    arr = vector_to_array("map")
    return out.select(key, arr[0].alias("x"), arr[1].alias("y"), "map")


def member_arrays(points: DataFrame, ks: Sequence[int], algorithms: Sequence[str] = ALGORITHMS, reps: int = 100, seed: int = SEED,
                  fraction: float = 0.8, key: str = "cod", features: str = "map") -> tuple[DataFrame, list[LS.Fit]]:
    """Base clusterings of every k (L3), wide: ``(cod, labels)`` with one label per fit, and the fits.

    Each (algorithm, repetition) is fitted on a subsample of its own, about
    ``fraction`` of the funds chosen by hash (so it does not depend on how
    the rows are partitioned), and then labels **all** funds. A fit whose
    subsample holds no more than ``k`` funds is fitted on all of them. A k
    that is not below the number of funds has no fits.
    """
    n = points.count()
    fits = [LS.Fit(a, r, k) for k in ks if 2 <= k < n for a in algorithms for r in range(reps)]
    if not fits:
        return points.select(key, F.array().cast("array<int>").alias("labels")), []
    ready = LS.dealt(LS.prepare(points, key, features), n).checkpoint(eager=True)
    return LS.label_many(ready, LS.fit_many(ready, fits, seed, fraction), key).checkpoint(eager=True), fits


def long_labels(arrays: DataFrame, fits: Sequence[LS.Fit], k: int, algorithms: Sequence[str], reps: int, key: str = "cod") -> DataFrame:
    """``(cod, algorithm, k, run, label)`` of ``member_arrays`` for one k; NULL labels where k has no fits."""
    wanted = [(a, r) for a in algorithms for r in range(reps)]
    at = {(f.algorithm, f.rep): i for i, f in enumerate(fits) if f.k == k}
    entries = F.array(*[F.struct(F.lit(a).alias("algorithm"), F.lit(f"{a}-{r}").alias("run"), F.lit(at.get((a, r), -1)).alias("at")) for a, r in wanted])
    each = arrays.select(key, "labels", F.explode(entries).alias("x"))
    return each.select(key, "x.algorithm", F.lit(k).alias("k"), "x.run", F.get("labels", F.col("x.at")).alias("label"))


def member_labels(points: DataFrame, k: int, algorithms: Sequence[str] = ALGORITHMS, reps: int = 100,
                  seed: int = SEED, fraction: float = 0.8, key: str = "cod", features: str = "map") -> DataFrame:
    """Base clusterings ``(cod, algorithm, k, run, label)`` of one k (L3), see ``member_arrays``.

    With ``k`` funds or fewer every label is NULL."""
    arrays, fits = member_arrays(points, [k], algorithms, reps, seed, fraction, key, features)
    return long_labels(arrays, fits, k, algorithms, reps, key)


def label_arrays(labels: DataFrame, key: str = "cod") -> tuple[DataFrame, int]:
    """Long labels as ``(cod, labels)``, an entry per run in order of its name (-1 where a fund has none), and the number of runs."""
    # one row per run (algorithms x repetitions): a handful
    names = sorted(r[0] for r in labels.select("run").distinct().collect())
    by = labels.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("run", "label"))).alias("_m"))
    return by.select(key, F.transform(F.array(*map(F.lit, names)), lambda r: F.coalesce(F.col("_m")[r], F.lit(-1))).alias("labels")), len(names)


def label_vectors(labels: DataFrame, k: int, key: str = "cod") -> DataFrame:
    """One-hot label vector per fund over all runs: position
    ``run_index * k + label``. ``<v_i, v_j>`` = runs where i and j agree."""
    arrays, _ = label_arrays(labels, key)
    one_hot = F.flatten(F.transform("labels", lambda x: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (x == j).cast("double"))))
    return arrays.select(key, array_to_vector(one_hot).alias("votes"))


def co_association(labels: DataFrame, a: str, b: str | None = None, key: str = "cod") -> DataFrame:
    """Share of runs in which funds ``a`` and ``b`` share a label, among
    runs that labelled both; without ``b`` of ``a`` and every other fund, one row
    each (linear in the labels; no all-pairs matrix)."""
    la = labels.where(F.col(key) == a).select("run", F.col("label").alias("_la"))
    lb = labels.where(F.col(key) == b if b is not None else F.col(key) != a).select(key, "run", F.col("label").alias("_lb"))
    # one fund's labels: an entry per run
    j = lb.join(F.broadcast(la), "run")
    aggs = [F.avg((F.col("_la") == F.col("_lb")).cast("double")).alias("co_association"), F.count(F.lit(1)).alias("runs")]
    return j.agg(*aggs) if b is not None else j.groupBy(key).agg(*aggs)


def consensus_cluster(labels: DataFrame, k: int, seed: int = SEED, key: str = "cod") -> DataFrame:
    """Consensus partition ``(cod, cluster)`` of the base clusterings (L4):
    one row per fund; NULL where the base labels are (``k`` funds or fewer)."""
    if not labels.where(F.col("label").isNull()).isEmpty():
        return labels.select(key).distinct().withColumn("cluster", F.lit(None).cast("int"))
    arrays, runs = label_arrays(labels, key)
    arrays = arrays.checkpoint(eager=True)
    got = LS.partition_many(arrays, LS.consensus_many(arrays, [range(runs)], [k], seed))
    return got.select(key, F.col("clusters")[0].alias("cluster"))


def sweep_partitions(points: DataFrame, grid: DataFrame, reps: int = 100, seed: int = SEED, key: str = "cod", features: str = "map",
                     members: tuple[DataFrame, list[LS.Fit]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Every row ``(subset, algorithms, k)`` of the grid clustered and scored (L5, D8): ``(n, subset, algorithms, k,
    silhouette)``, one row per grid row, and ``(cod, clusters)`` with the cluster of configuration n at place n - 1.

    Base clusterings are fitted once per (algorithm, k, repetition), or given
    by ``members`` (``member_arrays``), and shared by all subsets that contain
    the algorithm; consensus and scores of all configurations advance in
    lockstep. Score and cluster are NULL where ``k`` is not below the number
    of funds.
    """
    spark = points.sparkSession
    configs = [(r["subset"], r["algorithms"], r["k"]) for r in grid.orderBy("k", "subset").collect()]
    names = sorted({a for _, algos, _ in configs for a in algos.split("+")}, key=ALGORITHMS.index)
    arrays, fits = members or member_arrays(points, sorted({k for *_, k in configs}), names, reps, seed, key=key, features=features)
    some = {f.k for f in fits}
    live = [i for i, (_, _, k) in enumerate(configs) if k in some]
    scores: dict[int, float | None] = {}
    clusters = points.select(key, F.array().cast("array<int>").alias("clusters"))
    if live:
        ks = [configs[i][2] for i in live]
        sets = [[at for at, f in enumerate(fits) if f.k == configs[i][2] and f.algorithm in configs[i][1].split("+")] for i in live]
        clusters = LS.partition_many(arrays, LS.consensus_many(arrays, sets, ks, seed))
        rows = LS.prepare(points, key, features).join(clusters, key).select(key, "x", "clusters").checkpoint(eager=True)
        scores = dict(zip(live, LS.silhouettes(rows, ks)))
        clusters = rows.select(key, "clusters")
    place = {i: at for at, i in enumerate(live)}
    spread = F.array(*[F.get("clusters", F.lit(place[i])) if i in place else F.lit(None).cast("int") for i in range(len(configs))])
    table = [(i + 1, subset, algos, k, scores.get(i)) for i, (subset, algos, k) in enumerate(configs)]
    return (spark.createDataFrame(table, "n int, subset int, algorithms string, k int, silhouette double"),
            clusters.select(key, spread.alias("clusters")))


def silhouette_sweep(points: DataFrame, grid: DataFrame, reps: int = 100, seed: int = SEED, key: str = "cod") -> DataFrame:
    """The scores of ``sweep_partitions``."""
    return sweep_partitions(points, grid, reps, seed, key)[0]


def cluster_assignment(points: DataFrame, labels: DataFrame, dims: DataFrame | None = None,
                       key: str = "cod") -> DataFrame:
    """Final labels joined back to the map (and names)."""
    out = points.select(key, "x", "y").join(labels, key, "left")
    if dims is not None:
        out = out.join(dims, key, "left")
    return out
