"""Many clusterings fitted together.

A sweep asks for hundreds of fits of the same small-dimensional points: every
algorithm, repetition and number of clusters. All of them advance in lockstep:
one Spark job per iteration reads the points once, scores them against the
components of every fit that has not converged, and returns the components'
moments. The state of all fits (components x dimensions) and the moments are
bounded by the grid, not by the data; they are summed in slices, so that the
driver receives each number once, whatever the number of partitions.

* ``fit_many``: k-means, Gaussian mixtures and bisecting k-means; a fit is a
  function of its start and its subsample, so it equals the same fit alone.
* ``label_many``: one array of labels per point, an entry per fit.
* ``consensus_many``: the partition of the co-association similarity of sets
  of fits. With ``A`` the point x (fit, label) incidence and ``D`` the
  similarity's row sums, the leading eigenvectors of ``A' D^-1 A`` come from
  subspace iteration: each step is one pass that sends a vector from the
  labels to the points and back, linear in the labels. The points' rows of
  ``D^-1 A W`` are then split by k-means, all sets in lockstep.
* ``silhouettes``: the squared-Euclidean silhouette of every partition from
  two passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points (those with the smallest hashes) from which starts are drawn; the fits themselves read all points.
START = 2048
MAX_KMEANS, MAX_GMM, MAX_SPLIT = 30, 50, 20
#: A centre that moves less has converged; so has a mixture whose mean log-likelihood gains less.
MOVE, GAIN = 1e-6, 1e-5
#: Restarts of the consensus k-means and steps of its subspace iteration.
RESTARTS, STEPS = 8, 20
EXTRA = 4
#: Points of a task: at most, and the fewest for which the points are dealt to one more.
TASK_POINTS, LEAST_POINTS = 1 << 14, 1 << 8
_SLICE = 4096
_CELLS = 1 << 21
ALGORITHMS = ("kmeans", "gmm", "bisecting")


@dataclass(frozen=True)
class Fit:
    algorithm: str
    rep: int
    k: int


# --- one pass over the points -----------------------------------------------------------------------------------------
def prepare(points: DataFrame, key: str, features: DataFrame | str) -> DataFrame:
    """``(key, x, h)``: features as an array, and a hash of the key for subsamples."""
    from pyspark.ml.functions import vector_to_array

    kind = points.schema[features].dataType.typeName()
    x = F.col(features) if kind == "array" else vector_to_array(features)
    return points.select(key, x.cast("array<double>").alias("x"), F.xxhash64(key).alias("h"))


def dealt(points: DataFrame, n: int) -> DataFrame:
    """The ``n`` points in as many partitions as they are work for: a table of funds comes in one per bucket of its
    days, and every pass would start a task for each."""
    tasks = max(1, -(-n // TASK_POINTS), min(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_POINTS)))
    return points.repartition(tasks)


def matrix(col: pa.Array, kind=float) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(col), -1)


def summed(points: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part(batch)`` (``size`` numbers) over all batches."""
    def partial(batches):
        total = np.zeros(size)
        for rb in batches:
            if rb.num_rows:
                total += part(rb)
        cuts = [total[i:i + _SLICE] for i in range(0, size, _SLICE)]
        live = [i for i, x in enumerate(cuts) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([cuts[i].tobytes() for i in live], pa.binary())], names=["slice", "v"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for rb in batches:
            for i, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                held[i] = held.get(i, 0) + np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["slice", "v"])

    schema = "slice int, v binary"
    tasks = min(-(-size // _SLICE), int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = points.mapInArrow(partial, schema).repartition(tasks, "slice").mapInArrow(merge, schema).collect()
    total = np.zeros(size)
    for r in rows:
        v = np.frombuffer(r["v"])
        total[r["slice"] * _SLICE:r["slice"] * _SLICE + len(v)] = v
    return total


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _seeds(fits: Sequence[Fit], seed: int) -> np.ndarray:
    return _mix(np.array([(ALGORITHMS.index(f.algorithm) << 32) + f.rep + (seed << 40) + 1 for f in fits], np.uint64))


def _members(h: np.ndarray, seeds: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """(points, fits): whether a point is in a fit's subsample."""
    return _mix(h.view(np.uint64)[:, None] ^ seeds) % np.uint64(1_000_000) < limit


def _moments(x: np.ndarray) -> np.ndarray:
    """Per point 1, x and the products of its components."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)


def _spread(m: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight, mean and covariance of components from their moments ``(..., 1 + d + d (d + 1) / 2)``."""
    w = m[..., 0]
    safe = np.where(w > 0, w, 1)[..., None]
    mean = m[..., 1:1 + d] / safe
    i, j = np.triu_indices(d)
    cov = np.empty((*w.shape, d, d))
    cov[..., i, j] = cov[..., j, i] = m[..., 1 + d:] / safe - mean[..., i] * mean[..., j]
    return w, mean, cov


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (points, *centres.shape[:-1])."""
    out = np.zeros((len(x), *centres.shape[:-1]))
    for t in range(x.shape[1]):
        out += (x[:, t].reshape(-1, *[1] * (centres.ndim - 1)) - centres[..., t]) ** 2
    return out


def _hard_moments(label: np.ndarray, n: int, member: np.ndarray, z: np.ndarray) -> np.ndarray:
    """(fits, n, moments) of hard labels (points, fits)."""
    slot = (label + n * np.arange(label.shape[1])).ravel()
    size = n * label.shape[1]
    out = [np.bincount(slot, (member * z[:, t:t + 1]).ravel(), size) for t in range(z.shape[1])]
    return np.stack(out, axis=1).reshape(label.shape[1], n, -1)


# --- the three algorithms: fits with one k, side by side ------------------------------------------------------------
class KMeansFits:
    def __init__(self, starts: np.ndarray):
        self.centres = starts                                     # (fits, k, d)
        self.live = np.ones(len(starts), bool)
        self.rounds = 0

    def slots(self) -> int:
        return self.centres.shape[1]

    def labels(self, x: np.ndarray, fits=slice(None)) -> np.ndarray:
        return _distances(x, self.centres[fits]).argmin(axis=2)

    def part(self, x, z, member):
        return _hard_moments(self.labels(x, self.live), self.slots(), member, z)

    def update(self, m: np.ndarray) -> None:
        d = self.centres.shape[2]
        full = m[..., 0] > 0                                      # an empty cluster keeps its centre
        new = np.where(full[..., None], m[..., 1:1 + d] / np.where(full, m[..., 0], 1)[..., None], self.centres[self.live])
        moved = np.sqrt(((new - self.centres[self.live]) ** 2).sum(axis=2)).max(axis=1)
        self.centres[self.live] = new
        self.rounds += 1
        self.live[self.live] = (moved > MOVE) & (self.rounds < MAX_KMEANS)


class MixtureFits:
    """Gaussian mixtures with full covariances. A share of 1e-6 of the sample's variance is added to each diagonal,
    so that a component on one point stays defined."""

    def __init__(self, starts: np.ndarray, cov: np.ndarray):
        n, k, d = starts.shape
        self.floor = np.eye(d) * (1e-6 * np.trace(cov) / d + 1e-300)
        self.means, self.covs = starts, np.broadcast_to(cov + self.floor, (n, k, d, d)).copy()
        self.weights = np.full((n, k), 1.0 / k)
        self.live = np.ones(n, bool)
        self.last = np.full(n, -np.inf)
        self.rounds = 0

    def slots(self) -> int:
        return self.means.shape[1]

    def _log_parts(self, x, fits) -> np.ndarray:
        d = x.shape[1]
        low = np.linalg.inv(np.linalg.cholesky(self.covs[fits]))  # (fits, k, d, d)
        shift = np.einsum("fkij,fkj->fki", low, self.means[fits])
        y = np.zeros((len(x), *shift.shape[:2]))
        for t in range(d):
            y += (np.einsum("nj,fkj->nfk", x, low[:, :, t]) - shift[:, :, t]) ** 2
        log_det = np.log(np.einsum("fkii->fki", low)).sum(axis=2)
        with np.errstate(divide="ignore"):
            return np.log(self.weights[fits]) + log_det - 0.5 * (y + d * np.log(2 * np.pi))

    def labels(self, x: np.ndarray, fits=slice(None)) -> np.ndarray:
        return self._log_parts(x, fits).argmax(axis=2)

    def part(self, x, z, member):
        p = self._log_parts(x, self.live)
        top = p.max(axis=2, keepdims=True)
        p = np.exp(p - top)
        total = p.sum(axis=2, keepdims=True)
        p *= member[:, :, None] / total
        n, f, k = p.shape
        out = np.zeros((f, k + 1, z.shape[1]))                    # the last slot holds the log-likelihood
        out[:, :k] = (p.reshape(n, f * k).T @ z).reshape(f, k, -1)
        out[:, k, 0] = (member * (top + np.log(total))[:, :, 0]).sum(axis=0)
        return out

    def update(self, m: np.ndarray) -> None:
        d = self.means.shape[2]
        w, mean, cov = _spread(m[:, :-1], d)
        n = w.sum(axis=1)
        use = w > 1e-9                                            # a component without weight keeps its place
        self.means[self.live] = np.where(use[..., None], mean, self.means[self.live])
        self.covs[self.live] = np.where(use[..., None, None], cov + self.floor, self.covs[self.live])
        self.weights[self.live] = w / np.where(n > 0, n, 1)[:, None]
        fit = m[:, -1, 0] / np.where(n > 0, n, 1)
        self.rounds += 1
        gained = fit - self.last[self.live] > GAIN
        self.last[self.live] = fit
        self.live[self.live] = gained & (self.rounds < MAX_GMM)


class BisectingFits:
    """Divisive k-means: in each level the largest leaves split in two, along their widest axis, and two-means runs
    inside each; a leaf of equal points is not split. A point's leaf is found by descending the splits."""

    def __init__(self, fits: int, k: int, d: int):
        self.k, nodes = k, 2 * k - 1
        self.centres = np.zeros((fits, nodes, d))
        self.child = np.full((fits, nodes), -1)                   # left child; the right one follows it
        self.count = np.ones(fits, int)
        self.moving = np.zeros((fits, nodes), bool)               # children whose split still iterates
        self.solid = np.zeros((fits, nodes), bool)                # leaves that cannot be split
        self.live = np.ones(fits, bool)
        self.rounds = np.zeros(fits, int)

    def slots(self) -> int:
        return self.centres.shape[1]

    def _nodes(self, x: np.ndarray, fits) -> np.ndarray:
        child, centres = self.child[fits], self.centres[fits]
        node = np.zeros((len(x), len(child)), int)
        f = np.arange(len(child))
        while True:
            left = child[f, node]
            inner = left >= 0
            if not inner.any():
                return node
            to = np.maximum(left, 0)
            gap = ((x[:, None] - centres[f, to]) ** 2).sum(axis=2) - ((x[:, None] - centres[f, np.minimum(to + 1, self.slots() - 1)]) ** 2).sum(axis=2)
            node = np.where(inner, to + (gap > 0), node)

    def labels(self, x: np.ndarray, fits=slice(None)) -> np.ndarray:
        rank = np.cumsum(self._leaves()[fits], axis=1) - 1
        node = self._nodes(x, fits)
        return rank[np.arange(len(rank)), node]

    def _leaves(self) -> np.ndarray:
        return (self.child < 0) & (np.arange(self.slots()) < self.count[:, None])

    def part(self, x, z, member):
        return _hard_moments(self._nodes(x, self.live), self.slots(), member, z)

    def update(self, m: np.ndarray) -> None:
        d = self.centres.shape[2]
        weight, mean, cov = _spread(m, d)
        leaves = self._leaves()
        for at, f in enumerate(np.flatnonzero(self.live)):
            self.rounds[f] += 1
            moved = 0.0
            for t in np.flatnonzero(self.moving[f]):
                if weight[at, t] > 0:
                    moved = max(moved, float(np.sqrt(((mean[at, t] - self.centres[f, t]) ** 2).sum())))
                    self.centres[f, t] = mean[at, t]
            if moved > MOVE and self.rounds[f] < MAX_SPLIT:
                continue
            self.moving[f] = False
            self.rounds[f] = 0
            here = np.flatnonzero(leaves[f])
            widest = {}
            for t in here:
                values, axes = np.linalg.eigh(cov[at, t])
                if weight[at, t] < 2 or values[-1] <= 1e-12 * max(1e-300, float(np.abs(mean[at, t]).max()) ** 2) or self.solid[f, t]:
                    self.solid[f, t] = True
                else:
                    widest[t] = np.sqrt(values[-1]) * axes[:, -1]
            split = sorted(widest, key=lambda t: (-weight[at, t], t))[:self.k - len(here)]
            for t in split:
                left = self.count[f]
                self.child[f, t] = left
                self.centres[f, left], self.centres[f, left + 1] = mean[at, t] - widest[t], mean[at, t] + widest[t]
                self.moving[f, left:left + 2] = True
                self.count[f] += 2
            self.live[f] = bool(split)


# --- fits -----------------------------------------------------------------------------------------------------------
def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starts: each further one with the probability of its squared distance to the nearest so far."""
    out = [x[rng.integers(len(x))]]
    near = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < k:
        total = near.sum()
        i = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        out.append(x[i])
        near = np.minimum(near, ((x - x[i]) ** 2).sum(axis=1))
    return np.array(out)


def _chunks(rb: pa.RecordBatch, cells: int) -> Iterable[slice]:
    step = max(1, _CELLS // max(1, cells))
    return (slice(i, min(i + step, rb.num_rows)) for i in range(0, rb.num_rows, step))


@dataclass
class Fitted:
    fits: list[Fit]
    groups: list[tuple[list[int], object]]                        # positions in ``fits``, and the fits of one algorithm and k

    def labels(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.fits)), np.int32)
        for at, group in self.groups:
            out[:, at] = group.labels(x)
        return out


def start_many(points: DataFrame, fits: Sequence[Fit], seed: int, fraction: float) -> tuple[Fitted, np.ndarray, np.ndarray]:
    """Fits at their starts, and the seed and the limit of every fit's subsample.

    A subsample that holds no more than k points is replaced by all points."""
    fits = list(fits)
    seeds, share = _seeds(fits, seed), np.uint64(int(fraction * 1_000_000))

    def sizes(rb):
        return _members(rb.column(2).to_numpy(), seeds, np.full(len(fits), share)).sum(axis=0).astype(float)

    count = summed(points, sizes, len(fits))
    limit = np.where(count > [f.k for f in fits], share, np.uint64(1_000_000))
    sample = points.orderBy("h").limit(START).select("x", "h").collect()
    x = np.array([r["x"] for r in sample], float)
    member = _members(np.array([r["h"] for r in sample], np.int64), seeds, limit)
    groups = []
    for algorithm in ALGORITHMS:
        for k in sorted({f.k for f in fits if f.algorithm == algorithm}):
            at = [i for i, f in enumerate(fits) if (f.algorithm, f.k) == (algorithm, k)]
            if algorithm == "bisecting":
                groups.append((at, BisectingFits(len(at), k, x.shape[1])))
                continue
            starts = np.array([plus_plus(x[member[:, i]] if member[:, i].any() else x, k, np.random.default_rng([seed, ALGORITHMS.index(algorithm), fits[i].rep, k])) for i in at])
            cov = np.atleast_2d(np.cov(x.T, bias=True))
            groups.append((at, KMeansFits(starts) if algorithm == "kmeans" else MixtureFits(starts, cov)))
    return Fitted(fits, groups), seeds, limit


def fit_many(points: DataFrame, fits: Sequence[Fit], seed: int, fraction: float = 0.8) -> Fitted:
    """All fits over all points (``prepare``): one job per iteration until none moves."""
    fitted, seeds, limit = start_many(points, fits, seed, fraction)
    d = next((g.centres if hasattr(g, "centres") else g.means).shape[-1] for _, g in fitted.groups)
    width = 1 + d + d * (d + 1) // 2
    while any(g.live.any() for _, g in fitted.groups):
        now = [(np.array(at)[g.live], g) for at, g in fitted.groups if g.live.any()]
        sizes = [len(at) * (g.slots() + isinstance(g, MixtureFits)) * width for at, g in now]
        ends = np.cumsum([0, *sizes])

        def part(rb, now=now, ends=ends):
            x, h = matrix(rb.column(1)), rb.column(2).to_numpy()
            out = np.zeros(ends[-1])
            for (at, g), s, e in zip(now, ends, ends[1:]):
                for rows in _chunks(rb, (e - s) // width):
                    member = _members(h[rows], seeds[at], limit[at]).astype(float)
                    out[s:e] += g.part(x[rows], _moments(x[rows]), member).ravel()
            return out

        total = summed(points, part, int(ends[-1]))
        for (at, g), s, e in zip(now, ends, ends[1:]):
            g.update(total[s:e].reshape(len(at), -1, width))
    return fitted


def label_many(points: DataFrame, fitted: Fitted, key: str) -> DataFrame:
    """``(key, labels)``: the label of each point in every fit, in the order of ``fitted.fits``."""
    schema = f"{key} {points.schema[key].dataType.simpleString()}, labels array<int>"
    n = len(fitted.fits)

    def run(batches):
        for rb in batches:
            for rows in _chunks(rb, 8 * n):
                part = rb.slice(rows.start, rows.stop - rows.start)
                got = fitted.labels(matrix(part.column(1)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, n), pa.int32()), pa.array(got.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[key, "labels"])

    return points.mapInArrow(run, schema)


# --- consensus ------------------------------------------------------------------------------------------------------
@dataclass
class Consensus:
    """The partitions of sets of fits: ``sets[s]`` are positions in a label array, ``ks[s]`` their number of clusters."""
    sets: list[list[int]]
    ks: list[int]
    weights: list[np.ndarray]                                     # (fits of the set, k, dimensions)
    degrees: list[np.ndarray]                                     # (fits of the set, k): points of each label
    centres: list[np.ndarray]                                     # (k, dimensions)

    def labels(self, labels: np.ndarray) -> np.ndarray:
        out = np.empty((len(labels), len(self.sets)), np.int32)
        for s, (at, k) in enumerate(zip(self.sets, self.ks)):
            v = _carried(_incidence(labels[:, at], k), self.degrees[s], self.weights[s])
            out[:, s] = _distances(v, self.centres[s]).argmin(axis=1)
        return out


def _incidence(labels: np.ndarray, k: int) -> np.ndarray:
    """0/1 matrix (points, fits x k)."""
    return (labels[:, :, None] == np.arange(k)).reshape(len(labels), -1).astype(float)


def _carried(a: np.ndarray, degree: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Rows of ``D^-1 A u``; the similarity's row sum of a point is that of its labels' sizes."""
    return (a @ u.reshape(a.shape[1], -1)) / (a @ degree.ravel())[:, None]


def consensus_many(labels: DataFrame, sets: Sequence[Sequence[int]], ks: Sequence[int], seed: int) -> Consensus:
    """Spectral partition of the co-association of each set of fits (``labels`` as of ``label_many``)."""
    sets, ks = [list(s) for s in sets], list(ks)
    shapes = [(len(s), k) for s, k in zip(sets, ks)]
    rank = [min(k + EXTRA, n * k) for n, k in shapes]

    def each(sizes, step):
        """One pass: ``step(set, incidence)`` of every set, summed over the points."""
        ends = np.cumsum([0, *sizes])

        def part(rb):
            got = matrix(rb.column(1), int)
            out = np.zeros(ends[-1])
            for i, (at, k) in enumerate(zip(sets, ks)):
                for rows in _chunks(rb, len(at) * k):
                    out[ends[i]:ends[i + 1]] += step(i, _incidence(got[rows][:, at], k)).ravel()
            return out

        total = summed(labels, part, int(ends[-1]))
        return [total[a:b] for a, b in zip(ends, ends[1:])]

    degrees = [x.reshape(s) for x, s in zip(each([n * k for n, k in shapes], lambda i, a: a.sum(axis=0)), shapes)]
    rng = np.random.default_rng(seed)
    us = [np.linalg.qr(np.concatenate([np.ones((n * k, 1)), rng.normal(size=(n * k, r - 1))], axis=1))[0] for (n, k), r in zip(shapes, rank)]
    for step in range(STEPS + 1):
        got = each([n * k * r for (n, k), r in zip(shapes, rank)], lambda i, a, us=us: a.T @ _carried(a, degrees[i], us[i]))
        got = [x.reshape(n * k, r) for x, (n, k), r in zip(got, shapes, rank)]
        if step < STEPS:
            us = [np.linalg.qr(x)[0] for x in got]
            continue
        tops = []
        for u, x, k in zip(us, got, ks):                          # Rayleigh-Ritz: the k leading ones
            values, turn = np.linalg.eigh((u.T @ x + x.T @ u) / 2)
            tops.append(u @ turn[:, np.argsort(-values, kind="stable")[:k]])
    tops = [t.reshape(*s, -1) for t, s in zip(tops, shapes)]
    # k-means on the points' rows, several starts each; the rows are the same in all iterations, so they are written once
    ends = np.cumsum([0, *ks])

    def carry(batches):
        for rb in batches:
            got = matrix(rb.column(1), int) if rb.num_rows else None
            for rows in _chunks(rb, max(n * k for n, k in shapes)):
                v = np.concatenate([_carried(_incidence(got[rows][:, at], k), degrees[i], tops[i]) for i, (at, k) in enumerate(zip(sets, ks))], axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1]), pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([flat], names=["v"])

    carried = labels.mapInArrow(carry, "v array<double>").checkpoint(eager=True)

    def each_row(sizes, step):
        """One pass: ``step(set, rows)`` of every set, summed over the points."""
        places = np.cumsum([0, *sizes])

        def part(rb):
            v = matrix(rb.column(0))
            return np.concatenate([step(i, v[:, a:b]).ravel() for i, (a, b) in enumerate(zip(ends, ends[1:]))])

        total = summed(carried, part, int(places[-1]))
        return [total[a:b] for a, b in zip(places, places[1:])]

    name = labels.columns[0]
    sample = labels.orderBy(F.xxhash64(name)).limit(START).select("labels").collect()
    drawn = np.array([r["labels"] for r in sample], int)
    groups = []
    for i, (at, k) in enumerate(zip(sets, ks)):
        rows = _carried(_incidence(drawn[:, at], k), degrees[i], tops[i])
        groups.append(KMeansFits(np.array([plus_plus(rows, k, np.random.default_rng([seed, i, r])) for r in range(RESTARTS)])))
    while any(g.live.any() for g in groups):
        sizes = [int(g.live.sum()) * k * (k + 1) for g, k in zip(groups, ks)]

        def move(i, v):
            if not groups[i].live.any():
                return np.zeros(0)
            z = np.concatenate([np.ones((len(v), 1)), v], axis=1)
            return groups[i].part(v, z, np.ones((len(v), int(groups[i].live.sum()))))

        for g, k, m in zip(groups, ks, each_row(sizes, move)):
            if g.live.any():
                g.update(m.reshape(-1, k, k + 1))

    def loss(i, v):
        return _distances(v, groups[i].centres).min(axis=2).sum(axis=0)

    best = [int(x.argmin()) for x in each_row([RESTARTS] * len(sets), loss)]
    return Consensus(sets, ks, tops, degrees, [g.centres[b] for g, b in zip(groups, best)])


def partition_many(labels: DataFrame, consensus: Consensus) -> DataFrame:
    """``(key, clusters)``: the cluster of each point in every set."""
    key = labels.columns[0]
    n = len(consensus.sets)

    def run(batches):
        for rb in batches:
            for rows in _chunks(rb, max(len(s) * k for s, k in zip(consensus.sets, consensus.ks))):
                part = rb.slice(rows.start, rows.stop - rows.start)
                got = consensus.labels(matrix(part.column(1), int))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, n), pa.int32()), pa.array(got.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=[key, "clusters"])

    return labels.mapInArrow(run, f"{key} {labels.schema[key].dataType.simpleString()}, clusters array<int>")


def silhouettes(rows: DataFrame, ks: Sequence[int]) -> list[float | None]:
    """Mean squared-Euclidean silhouette of each partition of ``(key, x, clusters)``; ``None`` for a single cluster."""
    n, top = len(ks), max(ks)
    d = len(rows.select("x").first()["x"])
    width = d + 2

    def facts(rb):
        x, got = matrix(rb.column(1)), matrix(rb.column(2), int)
        z = np.concatenate([np.ones((len(x), 1)), x, (x * x).sum(axis=1, keepdims=True)], axis=1)
        return _hard_moments(got, top, np.ones(got.shape), z).ravel()

    f = summed(rows, facts, n * top * width).reshape(n, top, width)
    size = f[..., 0]
    safe = np.where(size > 0, size, 1)

    def scores(rb):
        x, got = matrix(rb.column(1)), matrix(rb.column(2), int)
        mean = (x * x).sum(axis=1)[:, None, None] + f[..., -1] / safe - 2 * np.einsum("nd,std->nst", x, f[..., 1:-1]) / safe[None]
        own = np.take_along_axis(mean, got[:, :, None], 2)[:, :, 0]
        mine = size[np.arange(n), got]
        a = own * mine / np.where(mine > 1, mine - 1, 1)
        mean = np.where(size[None] > 0, mean, np.inf)
        np.put_along_axis(mean, got[:, :, None], np.inf, 2)
        b = mean.min(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(a < b, 1 - a / b, np.where(a > b, b / a - 1, 0.0))
        return np.where(mine > 1, s, 0.0).sum(axis=0)

    total = summed(rows, scores, n)
    return [float(t / x.sum()) if (x > 0).sum() > 1 else None for t, x in zip(total, size)]
