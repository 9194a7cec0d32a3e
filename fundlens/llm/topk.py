"""Exact top-k search by inner product: columnar branch and bound.

Candidates and queries are dealt into blocks; every pair of blocks is one
task. A task keeps its candidates in vertical layout (one row per
dimension), accumulates the inner products one block of dimensions at a
time, and after each block compacts the surviving candidates: a candidate
goes when its partial score plus the remaining mass (Cauchy-Schwarz on the
dimensions not yet read) cannot reach the k-th best certain score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.llm.common import c

DIM_BLOCK = 16


def quantised(col: pa.ChunkedArray, dim: int, scale: float) -> np.ndarray:
    """``floor(scale * x)`` of a list column as a float64 matrix (integers)."""
    arr = col.combine_chunks()
    flat = arr.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).reshape(len(arr), dim)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, vecs: np.ndarray, k: int, most: int | None = None):
    """Top k rows of ``vecs`` for each query: ``(query index, row, score)``;
    with ``most``, rows with a larger absolute score are passed over.

    Exact while scores stay below 2^53 (float64 holds every integer there);
    beyond, Python integers are used."""
    n, dim = vecs.shape
    if not n or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
    peak = float(np.abs(q).max(initial=0)) * float(np.abs(vecs).max(initial=0)) * max(dim, 1)
    if peak >= 2.0 ** 52:
        return _search_big(q_ids, q, ids, vecs, k, most)
    cols = np.ascontiguousarray(vecs.T)                       # vertical layout
    cuts = list(range(0, dim, DIM_BLOCK)) + [dim]
    norms = lambda m: np.sqrt(np.concatenate(                 # noqa: E731  mass of the dimensions from each cut on
        [np.cumsum((m * m)[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))])[cuts])
    mass, q_mass = norms(cols), norms(np.ascontiguousarray(q.T))
    out_q, out_r, out_s = [], [], []
    first = cuts[1] if dim else 0
    for lo in range(0, len(q), 64):
        part = q[lo:lo + 64]
        seen = part[:, :first] @ cols[:first]                 # first block for all candidates
        for i in range(len(part)):
            alive, acc = np.flatnonzero(ids != q_ids[lo + i]), None
            acc = seen[i][alive]
            for b in range(1, len(cuts) - 1):
                rest = mass[b][alive] * q_mass[b, lo + i] * (1 + 1e-12) + 1e-9
                if len(alive) > k:
                    least = np.partition(acc - rest, len(acc) - k)[len(acc) - k]
                    keep = acc + rest >= least                # ties survive
                    alive, acc = alive[keep], acc[keep]
                s, e = cuts[b], cuts[b + 1]
                acc = acc + part[i, s:e] @ (cols[s:e, alive] if len(alive) * 3 < n else cols[s:e][:, alive])
            order = np.lexsort((ids[alive], -acc))[:k]
            out_q.append(np.full(len(order), lo + i, np.int64))
            out_r.append(alive[order])
            out_s.append(acc[order])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def _search_big(q_ids, q, ids, vecs, k, most):
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    qi, vi = exact(q), exact(vecs)
    out = []
    for i in range(len(qi)):
        best = sorted((-int(vi[r] @ qi[i]) if len(qi[i]) else 0, int(ids[r]), r) for r in np.flatnonzero(ids != q_ids[i]))
        best = [x for x in best if most is None or abs(x[0]) <= most]
        out += [(i, r, -s) for s, _, r in best[:k]]
    cols = list(zip(*out)) or [[], [], []]
    return np.array(cols[0], np.int64), np.array(cols[1], np.int64), np.array(cols[2], object)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 256.0, query_block: int = 2048, row_block: int = 16384) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query``
    selects, the ``k`` rows with the highest integer inner product of
    ``floor(scale * x)``; all, if fewer. Ties go to the smaller id.

    * vectors that are null or hold null, NaN or infinite components, and
      rows with a null id, take no part;
    * so does a vector with a component that is infinite once scaled;
    * only vectors of the query's own length are compared with it;
    * a pair whose score does not fit a long takes no part;
    * rows that share the query's id count as its own row and are left out;
      a query id that occurs in several rows gives the best of them all;
    * other columns are ignored; an empty table gives an empty result.

    The blocks are sized by the row counts, so a task's work does not grow
    with the table, only the number of block pairs does.
    """
    x = c(vec_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) != float("inf")))
    rows = df.where(c(id_col).isNotNull() & x.isNotNull() & finite)
    vecs = rows.select(c(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"), F.size(x).alias("dim"),
                       F.monotonically_increasing_id().alias("at"), is_query.alias("q"))
    sizes = vecs.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    n_rows, n_queries = max(1, -(-sizes["n"] // row_block)), max(1, -(-sizes["q"] // query_block))
    # each candidate goes to every query block and each query to every candidate block
    left = vecs.select("id", "v", "dim", F.pmod(F.col("at"), F.lit(n_rows)).cast("int").alias("rb"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"))
    queries = vecs.where("q").select("id", "v", "dim")
    queries = queries.dropDuplicates(["id", "v"])
    right = queries.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int").alias("qb"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()),
                           T.StructField("score", T.LongType())])

    def cell(key, cand: pa.Table, quer: pa.Table) -> pa.Table:
        dim = key[2].as_py()
        if not cand.num_rows or not quer.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        ids, q_ids = cand["id"].to_numpy(), quer["id"].to_numpy()
        qi, ri, s = search_block(q_ids, quantised(quer["v"], dim, scale), ids, quantised(cand["v"], dim, scale), k, (1 << 63) - 1)
        return pa.table({"query_id": pa.array(q_ids[qi]), "vec_id": pa.array(ids[ri]),
                         "score": pa.array([int(v) for v in s], pa.int64())})

    hits = left.groupBy("rb", "qb", "dim").cogroup(right.groupBy("rb", "qb", "dim")).applyInArrow(cell, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
