"""Boosted regression trees of many training folds, grown together.

An expanding backtest fits one boosted model per window. Here all of them
share their work: features are binned once, and rows with the same bins, which
no tree can tell apart, become one group with its sum of targets and its
number of rows (``pack``). The groups are read once per tree level for all
folds, and a pass returns the histograms (sum of residuals and rows by fold,
node, feature and bin) from which every fold's next splits are chosen. The
histograms' size is that of the trees and the bins, not of the data
(``lockstep.summed``). A row takes part in the folds that it trains; its
residuals differ between folds, so each has its own sums, but reading and
binning are one pass. Where a task can hold all groups, a fold is one task's
work and needs no passes.

``grow_folds`` grows them, ``fit_folds`` by passes in any case; ``as_pipeline`` turns one into a Spark ML pipeline
whose prediction is a single SQL expression.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.operators.lockstep import _mix, matrix, summed
from fundlens.operators.quantiles import array_quantiles

#: Bins of a feature, depth and number of trees, weight of all trees but the first.
BINS, DEPTH, TREES, STEP = 32, 4, 30, 0.1
#: Trees after which the rows' predictions so far are written, so that a pass descends few trees.
WRITE_EVERY = 5
#: Rows of a task: at most, and the fewest for which the rows are dealt to one more.
TASK_ROWS, LEAST_ROWS = 1 << 17, 1 << 15
#: Quantile sketches at most, and the rows up to which edges come from sketches.
SKETCHES, SKETCH_ROWS = 64, 1 << 20
#: Groups of equal rows that a single task holds and grows a fold on; more of them are read by passes.
MEMORY_ROWS = 1 << 21
#: Joint codes of a bundle of features at most.
CELLS = 1 << 10
#: A split has to lower the squared error by more than this share of the node's.
LEAST_GAIN = 1e-9
_SCHEMA = "m int, codes binary, y binary, n binary, b binary, f binary"


@dataclass
class Tree:
    """Nodes in heap order: children of node i are 2i + 1 and 2i + 2. Rows with ``code <= cut`` go left."""
    feature: np.ndarray                                   # -1: a leaf
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), int)
        every = np.arange(len(codes))
        while True:
            f = self.feature[node]
            if (f < 0).all():
                return node
            go = 2 * node + 1 + (codes[every, np.maximum(f, 0)] > self.cut[node])
            node = np.where(f < 0, node, go)


@dataclass
class Boosted:
    """One fold's model: ``base`` plus its trees, on features binned at ``edges`` (bin = edges below the value)."""
    base: float
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        for t in self.trees:
            out += t.value[t.nodes(codes)]
        return out


def bin_codes(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)


def feature_edges(rows: DataFrame, n_features: int, bins: int = BINS) -> list[np.ndarray]:
    """Quantile edges of every feature of the array ``x``: the distinct values at the ranks ``ceil(i n / bins)``.

    Few rows are one mergeable aggregate, of a bounded number of sketches (rank error 1e-4); one task merges these, which
    takes longer than exact ranks where they are many."""
    grid = [i / bins for i in range(1, bins)]
    if rows.count() > SKETCH_ROWS:
        return [np.unique(x) for x in array_quantiles(rows, n_features, grid, TASK_ROWS)]
    got = rows.coalesce(SKETCHES).agg(*[F.percentile_approx(F.col("x")[j], grid, 10_000).alias(f"e{j}") for j in range(n_features)]).first()
    return [np.unique(np.array(e if e is not None else [], float)) for e in got]


def _split(hist: np.ndarray, weight: float, tree: Tree, node: int) -> bool:
    """Best split of a node from its histogram (features, bins, 2): the first of equal gains."""
    g, n = hist[..., 0], hist[..., 1]
    total, count = g[0].sum(), n[0].sum()
    gl, nl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    gr, nr = total - gl, count - nl
    ok = (nl > 0.5) & (nr > 0.5)
    gain = np.where(ok, gl * gl / np.where(ok, nl, 1) + gr * gr / np.where(ok, nr, 1), -np.inf) - total * total / max(count, 1)
    best = int(gain.argmax())
    f, b = divmod(best, gain.shape[1])
    if not gain[f, b] > LEAST_GAIN * max(1e-300, abs(total * total / max(count, 1)) + np.abs(gain[ok]).max(initial=0.0) * 1e-3):
        return False
    tree.feature[node], tree.cut[node] = f, b
    tree.value[2 * node + 1], tree.value[2 * node + 2] = weight * gl[f, b] / nl[f, b], weight * gr[f, b] / nr[f, b]
    return True


class Bundles:
    """Features side by side in one code, as long as their joint codes stay few: a histogram of the joint code, summed
    over the other features, is that of each."""

    def __init__(self, edges: Sequence[np.ndarray]):
        self.sizes = [len(e) + 1 for e in edges]
        self.of: list[list[int]] = []
        cells = CELLS
        for j, size in enumerate(self.sizes):
            if cells * size > CELLS:
                self.of.append([])
                cells = 1
            self.of[-1].append(j)
            cells *= size

    def joint(self, codes: np.ndarray) -> list[np.ndarray]:
        """A line of joint codes per bundle; ``codes`` has a line per feature."""
        out = []
        for features in self.of:
            x = codes[features[0]].astype(np.uint16)
            for j in features[1:]:
                x = x * np.uint16(self.sizes[j]) + codes[j]
            out.append(x)
        return out

    def add(self, out: np.ndarray, joint: Sequence[np.ndarray], at: np.ndarray, values: Sequence[np.ndarray]) -> None:
        """Adds the sums of each of ``values`` (of the rows ``at``) by feature and code to ``out[feature, code, value]``."""
        for features, x in zip(self.of, joint):
            sizes = [self.sizes[j] for j in features]
            place = x[at].astype(np.intp)
            for i, v in enumerate(values):
                cells = np.bincount(place, v, int(np.prod(sizes))).reshape(sizes)
                for axis, j in enumerate(features):
                    out[j, :sizes[axis], i] += cells.sum(axis=tuple(x for x in range(len(sizes)) if x != axis))


def _rows_at(tree: Tree, codes: np.ndarray, node: int, held: dict[int, np.ndarray]) -> np.ndarray:
    """The rows that reach a node; ``held`` has those of the root, and keeps those found on the way."""
    if node not in held:
        up = (node - 1) // 2
        at = _rows_at(tree, codes, up, held)
        right = codes[tree.feature[up]][at] > tree.cut[up]
        held[2 * up + 1], held[2 * up + 2] = at[~right], at[right]
    return held[node]


def _leaves(tree: Tree, codes: np.ndarray, held: dict[int, np.ndarray]):
    """``(node, its rows)`` of the tree's leaves below the root's rows in ``held``."""
    left = [0]
    while left:
        i = left.pop()
        at = _rows_at(tree, codes, i, held)
        if tree.feature[i] < 0 or not len(at):
            yield i, at
        else:
            left += [2 * i + 1, 2 * i + 2]


def _grow(by: np.ndarray, edges: Sequence[np.ndarray], trees: int, depth: int, histograms: Callable, grown: Callable) -> list[Boosted]:
    """Models of all folds from their sums of targets and rows ``by``. ``histograms(ask, growing, models)`` gives those
    of the asked ``(fold, node)``, ``grown(models)`` is told of every round of trees.

    Below a root only the histogram of a split's smaller side is asked for; the other side's is the difference to
    the split node's."""
    models = [Boosted(float(s / n) if n else 0.0, list(edges)) for s, n in by.T]
    for number in range(trees):
        growing = [Tree.empty(depth) for _ in models]
        held: dict[tuple[int, int], np.ndarray] = {}
        ask = [(k, 0) for k in range(len(models))]
        for _ in range(depth):
            if not ask:
                break
            total = histograms(ask, growing, models)
            now = dict(zip(ask, total))
            for (k, node), h in zip(ask, total):
                if node:
                    now[k, node + 1 if node % 2 else node - 1] = held[k, (node - 1) // 2] - h
            held, ask = now, []
            for (k, node), h in sorted(held.items(), key=lambda x: x[0]):
                if h[0, :, 1].sum() >= 2 and _split(h, STEP if number else 1.0, growing[k], node):
                    side = h[growing[k].feature[node], :, 1]
                    fewer = side[:growing[k].cut[node] + 1].sum() * 2 <= side.sum()
                    ask.append((k, 2 * node + (1 if fewer else 2)))
        for m, t in zip(models, growing):
            m.trees.append(t)
        grown(models)
    return models


def grouped(codes: np.ndarray, y: np.ndarray, n: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows with the same codes and the same folds as one: a hash, codes, summed targets, number of rows, folds.

    Trees see codes only, so such rows share every node and every prediction. Rows are compared whole; two groups
    whose hashes are equal may stay in pieces, which changes no sum."""
    d = codes.shape[1]
    wide = np.zeros((len(y), -(-(d + 4) // 8) * 8), np.uint8)
    wide[:, :d] = codes
    wide[:, d:d + 4] = np.ascontiguousarray(b, np.int32).view(np.uint8).reshape(-1, 4)
    words = wide.view(np.uint64)
    h = np.zeros(len(y), np.uint64)
    for j in range(words.shape[1]):
        h = _mix(h ^ words[:, j])
    order = np.argsort(h, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)]))
    mine = order[first]
    return h[mine], codes[mine], np.add.reduceat(y[order], first), np.add.reduceat(n[order], first), b[mine]


def _tasks(spark, rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // LEAST_ROWS)))


def pack(rows: DataFrame, folds: int, edges: Sequence[np.ndarray]) -> tuple[DataFrame, int]:
    """``(x, y, b)`` as blocks ``(m, codes, y, n, b, f)`` of ``m`` groups of equal rows, features by line, and the number of groups.

    Equal rows are summed where they lie, then brought together by their hash: the blocks of a task hold a bounded
    number of rows, and every pass is as many tasks' work as there are groups."""
    spark = rows.sparkSession
    d = len(edges)
    data = rows.select("x", F.col("y").cast("double"), F.col("b").cast("int")).where("y IS NOT NULL AND b > 0")
    parts, most = _tasks(spark, data.count()), TASK_ROWS

    def sent(held):
        h, codes, y, n, b = grouped(*[np.concatenate(x) for x in zip(*held)])
        to = (h % np.uint64(parts)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            block = [to[at[0]], codes[at].tobytes(), y[at].tobytes(), n[at].tobytes(), b[at].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block, [pa.int32(), *[pa.binary()] * 4])], names=["part", "codes", "y", "n", "b"])

    def binned(batches):
        held, size = [], 0
        for rb in batches:
            if rb.num_rows:
                held.append((bin_codes(matrix(rb.column(0)), edges).astype(np.uint8), rb.column(1).to_numpy(), np.ones(rb.num_rows),
                             np.minimum(rb.column(2).to_numpy(), folds).astype(np.int32)))
                size += rb.num_rows
                if size >= most:
                    yield from sent(held)
                    held, size = [], 0
        if held:
            yield from sent(held)

    def merged(batches):
        held = []
        for rb in batches:
            for codes, y, n, b in zip(*(rb.column(j).to_pylist() for j in range(1, 5))):
                held.append((np.frombuffer(codes, np.uint8).reshape(-1, d), np.frombuffer(y), np.frombuffer(n), np.frombuffer(b, np.int32)))
        if held:
            _, codes, y, n, b = grouped(*[np.concatenate(x) for x in zip(*held)])
            for i in range(0, len(y), most):
                at = slice(i, i + most)
                block = [len(y[at]), codes[at].T.tobytes(), y[at].tobytes(), n[at].tobytes(), b[at].tobytes(), None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block, [pa.int32(), *[pa.binary()] * 5])], names=["m", "codes", "y", "n", "b", "f"])

    data = data.mapInArrow(binned, "part int, codes binary, y binary, n binary, b binary").repartitionById(parts, F.col("part"))
    data = data.mapInArrow(merged, _SCHEMA).checkpoint(eager=True)
    groups = data.agg(F.sum("m")).first()[0] or 0
    tasks = _tasks(spark, groups)
    return (data.coalesce(tasks) if tasks < parts else data), groups


def _blocks(rb, d: int, folds: int):
    """Codes (a line per feature), targets, rows, folds and, once written, predictions (a line per fold)."""
    for m, codes, y, n, b, f in zip(*(rb.column(j).to_pylist() for j in range(6))):
        yield (np.frombuffer(codes, np.uint8).reshape(d, m), np.frombuffer(y), np.frombuffer(n), np.frombuffer(b, np.int32),
               None if f is None else np.frombuffer(f).reshape(folds, m))


def _by_passes(data: DataFrame, folds: int, edges: Sequence[np.ndarray], trees: int, depth: int, write_every: int) -> list[Boosted]:
    """All folds from passes over the blocks: one per tree level."""
    d, width, bundles = len(edges), max(len(e) for e in edges) + 1, Bundles(edges)

    def sums(rb):
        out = np.zeros(2 * (folds + 1))
        for _, y, n, b, _ in _blocks(rb, d, folds):
            out += np.concatenate([np.bincount(b, y, folds + 1), np.bincount(b, n, folds + 1)])
        return out

    by = summed(data, sums, 2 * (folds + 1)).reshape(2, -1)[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]      # cumulated: fold k has buckets k and up
    written = 0

    def predicted(model, codes, f, at, first):
        """Predictions of a fold for the rows ``at`` of a block, from the written ones and the trees grown since."""
        now = np.full(codes.shape[1], model.base) if f is None else f.copy()
        for t in model.trees[first:]:
            for node, mine in _leaves(t, codes, {0: at}):
                now[mine] += t.value[node]
        return now

    def histograms(ask, growing, models):
        wanted: dict[int, list[tuple[int, int]]] = {}
        for i, (k, node) in enumerate(ask):
            wanted.setdefault(k, []).append((i, node))

        def part(rb, first=written):
            out = np.zeros((len(ask), d, width, 2))
            for codes, y, n, b, f in _blocks(rb, d, folds):
                joint = bundles.joint(codes)
                for k, places in wanted.items():
                    held = {0: np.flatnonzero(b > k)}                       # fold k + 1 counts from 1
                    found = [(i, at) for i, at in ((i, _rows_at(growing[k], codes, node, held)) for i, node in places) if len(at)]
                    if found:
                        now = predicted(models[k], codes, None if f is None else f[k], np.concatenate([at for _, at in found]), first)
                        for i, at in found:
                            bundles.add(out[i], joint, at, [y[at] - n[at] * now[at], n[at]])
            return out.ravel()

        return summed(data, part, len(ask) * d * width * 2).reshape(len(ask), d, width, 2)

    def grown(models):
        nonlocal data, written
        number = len(models[0].trees) if models else 0
        if number % write_every == 0 and number < trees:
            def advance(batches, first=written):
                for rb in batches:
                    now = [np.stack([predicted(models[k], codes, None if f is None else f[k], np.flatnonzero(b > k), first) for k in range(folds)]).tobytes()
                           for codes, _, _, b, f in _blocks(rb, d, folds)]
                    yield pa.RecordBatch.from_arrays([*rb.columns[:5], pa.array(now, pa.binary())], names=rb.schema.names)

            data = data.mapInArrow(advance, _SCHEMA).checkpoint(eager=True)
            written = number

    return _grow(by, edges, trees, depth, histograms, grown)


def _in_memory(codes: np.ndarray, y: np.ndarray, n: np.ndarray, edges: Sequence[np.ndarray], trees: int, depth: int) -> Boosted:
    """One fold from all its groups of rows."""
    d, width, bundles = len(edges), max(len(e) for e in edges) + 1, Bundles(edges)
    joint, every = bundles.joint(codes), np.arange(len(y))
    by = np.array([[y.sum()], [n.sum()]])
    left = y - n * (by[0, 0] / by[1, 0] if len(y) else 0.0)                 # summed residuals
    held = {0: every}

    def histograms(ask, growing, models):
        out = np.zeros((len(ask), d, width, 2))
        for i, (_, node) in enumerate(ask):
            at = _rows_at(growing[0], codes, node, held)
            bundles.add(out[i], joint, at, [left[at], n[at]])
        return out

    def grown(models):
        nonlocal held
        for node, at in _leaves(models[0].trees[-1], codes, held):
            left[at] -= n[at] * models[0].trees[-1].value[node]
        held = {0: every}

    return _grow(by, edges, trees, depth, histograms, grown)[0]


def _by_tasks(data: DataFrame, folds: int, edges: Sequence[np.ndarray], trees: int, depth: int) -> list[Boosted]:
    """Each fold in one task that holds its groups of rows: a single job, without passes."""
    d = len(edges)

    def fit(batches):
        held: dict[int, list] = {}
        for rb in batches:
            for k, (codes, y, n, b, _) in zip(rb.column(6).to_pylist(), _blocks(rb, d, folds)):
                mine = b >= k
                held.setdefault(k, []).append((codes[:, mine], y[mine], n[mine]))
        for k, parts in held.items():
            model = _in_memory(*[np.concatenate(x, axis=-1) for x in zip(*parts)], edges, trees, depth)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())], names=["fold", "model"])

    each = data.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds)))).repartitionById(folds, F.col("fold") - 1)
    got = {r["fold"]: pickle.loads(r["model"]) for r in each.mapInArrow(fit, "fold int, model binary").collect()}
    return [got.get(k) or Boosted(0.0, list(edges)) for k in range(1, folds + 1)]


def fit_folds(rows: DataFrame, folds: int, edges: Sequence[np.ndarray], trees: int = TREES, depth: int = DEPTH,
              write_every: int = WRITE_EVERY) -> list[Boosted]:
    """Models of the folds 1 to ``folds`` on ``(x array<double>, y double, b int)`` by passes: a row trains the folds up to ``b``."""
    return _by_passes(pack(rows, folds, edges)[0], folds, edges, trees, depth, write_every)


def grow_folds(rows: DataFrame, folds: int, edges: Sequence[np.ndarray], trees: int = TREES, depth: int = DEPTH) -> list[Boosted]:
    """The models of ``fit_folds``; groups of rows that a task can hold are grown in a task per fold instead of by passes."""
    data, groups = pack(rows, folds, edges)
    if groups <= MEMORY_ROWS:
        return _by_tasks(data, folds, edges, trees, depth)
    return _by_passes(data, folds, edges, trees, depth, WRITE_EVERY)


def predict_folds(rows: DataFrame, models: Sequence[Boosted], name: str = "mean") -> DataFrame:
    """``rows`` (with ``x`` and ``fold`` from 1) and the prediction of their fold's model in place of ``x``."""
    kept = [f for f in rows.schema.fields if f.name != "x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{name}` double"
    names = [f.name for f in kept]

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            codes = bin_codes(matrix(rb.column(rb.schema.get_field_index("x"))), models[0].edges)
            fold = rb.column(rb.schema.get_field_index("fold")).to_numpy()
            out = np.zeros(rb.num_rows)
            for k in np.unique(fold):
                out[fold == k] = models[k - 1].predict(codes[fold == k])
            yield pa.RecordBatch.from_arrays([*[rb.column(rb.schema.get_field_index(x)) for x in names], pa.array(out)], names=[*names, name])

    return rows.mapInArrow(run, schema)


def as_pipeline(model: Boosted, cols: Sequence[str], name: str = "mean") -> PipelineModel:
    """The model as a pipeline that Spark saves, loads and runs without Python: nested conditions per tree."""
    def node(t: Tree, i: int) -> str:
        f = t.feature[i]
        if f < 0:
            return repr(float(t.value[i])) + "D"
        edges = model.edges[f]
        if t.cut[i] >= len(edges):
            return node(t, 2 * i + 1)
        return f"CASE WHEN CAST(`{cols[f]}` AS DOUBLE) <= {float(edges[t.cut[i]])!r}D THEN {node(t, 2 * i + 1)} ELSE {node(t, 2 * i + 2)} END"

    total = " + ".join([f"{model.base!r}D", *[f"({node(t, 0)})" for t in model.trees]])
    return PipelineModel([SQLTransformer(statement=f"SELECT *, {total} AS `{name}` FROM __THIS__")])
