"""Hard-negative mining with Fagin's threshold algorithm.

Rows are dealt into blocks; a block is read once by one task, which sorts its
rows by every dimension, and the anchors then pass through it as a stream. An
anchor reads the sorted lists from the end that its sign prefers (descending
where its component is positive, ascending where it is negative), scores each
row it meets for the first time by random access, and stops once the threshold
(the score of a row made of the last values read) lies strictly below the k-th
score of each of its windows, or below a window itself: no row unseen can
change the result.

Two rounds: the best rows of the anchor's own label are its positives; each
positive's score then opens a window for the rows of other labels. Blocks
return their best rows per window, and the best of all blocks are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import Scratch, arrow_map, c, partitions, written
from fundlens.llm.topk import quantised

#: Rows of a block at most on average: its matrix and sorted lists are in one task's memory (8 bytes x dimensions a row).
BLOCK = 1 << 18
#: Blocks of a smaller table (not more than shuffle partitions).
BLOCKS = 8
#: Depth of the first round of sorted access; each round doubles it.
FIRST_DEPTH = 16
LONG = 1 << 63


def exact_type(a: np.ndarray, x: np.ndarray):
    """The cheapest type that holds all partial sums of ``x @ a`` exactly (Cauchy-Schwarz on the largest norms)."""
    norm = lambda m: float(np.sqrt((m * m).sum(axis=1)).max(initial=0.0))
    with np.errstate(over="ignore"):
        peak = norm(a) * norm(x)
    return np.float32 if peak < 2.0 ** 23 else np.float64 if peak < 2.0 ** 52 else object


def as_type(m: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return m.astype(kind)


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """Row numbers in ascending order of each dimension: (dimensions, rows)."""
    return np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))


def threshold_search(a: np.ndarray, x: np.ndarray, lists: np.ndarray, fits: np.ndarray, windows: list[tuple], k: int,
                     first: int = FIRST_DEPTH):
    """For each window ``(low, high)`` the rows whose score lies in it, from the ``k``-th best score on (ties
    included): ``[(rows, scores)]``, and the number of rows scored. Rows where ``fits`` is false are passed over."""
    n = len(x)
    up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
    seen, done = np.zeros(n, bool), np.zeros(n, bool)
    rows, scores = [], []
    depth, reach = 0, first
    while True:
        reach = min(reach, n)
        seen[lists[up, n - reach:n - depth]] = True
        seen[lists[down, depth:reach]] = True
        new = np.flatnonzero(seen & ~done)
        done[new] = True
        new = new[fits[new]]
        if len(new):
            rows.append(new)
            scores.append(x[new] @ a)
        every = np.sort(np.concatenate(scores)) if scores else np.zeros(0, x.dtype)
        least = []                                           # per window: its k-th score, or its low end
        for low, high in windows:
            i, j = np.searchsorted(every, low), np.searchsorted(every, high, "right")
            least.append(every[j - k] if j - i >= k else low)
        if reach == n or done.all() or not (len(up) or len(down)):
            break
        threshold = (a[up] * x[lists[up, n - reach], up]).sum() + (a[down] * x[lists[down, reach - 1], down]).sum()
        if all(threshold < s for s in least):
            break
        depth, reach = reach, 2 * reach
    if not (len(up) or len(down)):                           # a zero anchor prefers no end: every row scores 0
        rows = [np.flatnonzero(fits)]
        scores = [np.zeros(len(rows[0]), x.dtype)]
        least = [low for low, _ in windows]
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    scores = np.concatenate(scores) if scores else np.zeros(0, x.dtype)
    out = []
    for (_, high), low in zip(windows, least):
        hit = np.flatnonzero((scores >= low) & (scores <= high))
        out.append((rows[hit], scores[hit]))
    return out, len(rows)


class Block:
    """The rows of one block, with sorted lists of all of them or of one label's."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x, self.kept = ids, labels, x, {}

    def part(self, kind, label: int | None):
        """``(row numbers, matrix, lists)`` of the rows of ``label``, or of all."""
        if (kind, label) not in self.kept:
            rows = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
            x = as_type(self.x[rows], kind)
            self.kept[kind, label] = rows, x, sorted_lists(x)
        return self.kept[kind, label]

    def best(self, anchor_id: int, label: int, a: np.ndarray, windows: list[tuple] | None, k: int):
        """The ``k`` best rows per window, ties to smaller ids: same label without windows, other labels with them."""
        kind = exact_type(a[None], self.x)
        rows, x, lists = self.part(kind, label if windows is None else None)
        ids = self.ids[rows]
        fits = ids != anchor_id
        if windows is not None:
            fits &= self.labels[rows] != label
        found, _ = threshold_search(as_type(a[None], kind)[0], x, lists, fits, windows or [(1 - LONG, LONG - 1)], k)
        out = []
        for r, s in found:
            ok = [(-int(v), i) for v, i in zip(s.tolist(), ids[r].tolist())]
            out.append([(i, -v) for v, i in sorted(ok)[:k]])
        return out


def search(rows: DataFrame, anchors: DataFrame, k: int, blocks: int, scale: float) -> DataFrame:
    """``(a, w, id, score)``: for each anchor ``a`` and window ``w`` (0 without windows) the best rows of each block.

    Rows and anchors of a block lie in one partition, rows first: a task holds one block, and anchors stream by.
    Rows are shuffled once; anchors, the few, go to every block."""
    fields = ["dim", "block", "kind", "id", "label", "v", "a", "windows"]
    none = F.lit(None).cast(anchors.schema["windows"].dataType)
    left = rows.select("dim", F.pmod("at", F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "v",
                       F.lit(None).cast("long").alias("a"), none.alias("windows"))
    right = anchors.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"),
                           "id", "label", "v", "a", "windows")
    both = left.unionByName(right).select(*fields).repartition(max(blocks, partitions(rows.sparkSession)), "dim", "block")
    both = both.sortWithinPartitions("dim", "block", "kind")

    def run(batches):
        place, waiting, block = None, [], None
        for rb in batches:
            keys = list(zip(*(rb.column(i).to_numpy().tolist() for i in range(3))))
            cuts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                dim, number, kind = keys[s]
                if (dim, number) != place:
                    place, waiting, block = (dim, number), [], None
                part = rb.slice(s, e - s)
                ids, labels = part.column(3).to_numpy(), part.column(4).to_numpy()
                vecs = quantised(pa.chunked_array([part.column(5)]), dim, scale)
                if kind == 0:
                    waiting.append((ids, labels, vecs))
                    continue
                if block is None:
                    if not waiting:
                        continue                             # no row of this length in the block
                    block = Block(*(np.concatenate(x) for x in zip(*waiting)))
                    waiting = []
                out = []
                windows = part.column(7).to_pylist()
                for i, a in enumerate(part.column(6).to_pylist()):
                    spans = None if windows[i] is None else [(w["low"], w["high"]) for w in windows[i]]
                    for w, hits in enumerate(block.best(int(ids[i]), int(labels[i]), vecs[i], spans, k)):
                        out += [(a, w, x, v) for x, v in hits]
                cols = list(zip(*out)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
                                                  pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["a", "w", "id", "score"])

    found = arrow_map(both, run, "a long, w int, id long, score long")
    best = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
                   block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    An anchor's positives are its ``positives`` best other rows of the same label; for each, the ``negatives`` best
    rows of other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned.
    Scores are exact integer inner products of ``floor(scale * x)``; ties go to the smaller id.

    * rows with a null id, label or vector, or with a null, NaN or infinite component (scaled ones included), take no part;
    * only vectors of one length are compared; the empty vector scores 0 with its like;
    * rows that share the anchor's id count as its own and are left out; an anchor id with several different rows is
      several anchors under that id; identical anchor rows are one. Repeated rows are several positives or negatives;
    * pairs whose score does not fit a long take no part;
    * a positive with a negative score has no window; other columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch()
    x = c(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) != float("inf")))
    rows = df.where(c(id_col).isNotNull() & c(label_col).isNotNull() & x.isNotNull() & finite).select(
        c(id_col).cast("long").alias("id"), c(label_col).cast("long").alias("label"), x.cast("array<double>").alias("v"),
        F.size(x).alias("dim"), is_anchor.alias("q"))
    rows = scratch.written(rows.withColumn("at", F.monotonically_increasing_id()), "negatives-rows")
    n_blocks = max(-(-rows.count() // block), min(blocks, partitions(df.sparkSession)))
    window = "array<struct<positive: long, score: long, low: long, high: long>>"
    anchors = rows.where("q").select("id", "label", "v", "dim").dropDuplicates(["id", "label", "v"])
    anchors = scratch.written(anchors.withColumn("a", F.monotonically_increasing_id()), "negatives-anchors")
    found = search(rows, anchors.withColumn("windows", F.lit(None).cast(window)), positives, n_blocks, scale)
    # low * p <= 100 * s <= high * p for whole s; 100 * s and p * high would overflow, their quotients do not
    ceil_div = F.expr(f"cast(ceil(cast(score as decimal(38, 0)) * {low} / 100) as long)")
    floor_div = F.expr(f"cast(floor(cast(score as decimal(38, 0)) * {high} / 100) as long)")
    opened = (found.select("a", "rank", F.col("id").alias("positive"), "score", ceil_div.alias("low"), floor_div.alias("high"))
              .where("low <= high").groupBy("a")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "positive", "score", "low", "high"))).alias("_w")))
    opened = opened.select("a", F.transform("_w", lambda w: F.struct(w["positive"].alias("positive"), w["score"].alias("score"),
                                                                    w["low"].alias("low"), w["high"].alias("high"))).alias("windows"))
    asking = scratch.written(anchors.join(opened, "a"), "negatives-windows")
    taken = search(rows, asking, negatives, n_blocks, scale)
    out = taken.join(asking.select("a", F.col("id").alias("anchor_id"), "windows"), "a").withColumn("_p", F.expr("windows[w]"))
    out = written(out.select("anchor_id", F.col("_p.positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                             F.col("_p.score").alias("positive_score"), F.col("score").alias("negative_score")), "negatives")
    scratch.discard()
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.e::DOUBLE[], b.e::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id AND len(a.e) = len(b.e) WHERE a.id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (
  SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS r
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE r <= 3
"""
