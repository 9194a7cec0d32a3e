"""Exact quantiles of groups of any size.

Spark's ``percentile`` counts the distinct values of a group in one buffer.
Groups of up to ``limit`` values go that way. In a larger group the values at
the wanted ranks are found by distributed selection: each round draws a sketch
(``percentile_approx``, a mergeable buffer of bounded size) of the values
still in question, takes the two sketched values around the rank, and counts
exactly how many values lie below, on and between them. Values on a bound are
settled by their count, so a frequent value never stays in question. When at
most ``limit`` values are left they are sorted. The data are never moved, only
counts and sketches are, and a hot group is as many tasks' work as it has
partitions. The interpolation is that of ``percentile``, bit for bit.

``array_quantiles`` gives values at ranks, without interpolation, of all places
of an array column together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.operators.lockstep import matrix, summed

#: Values of a group that one buffer holds.
LIMIT = 1 << 17
#: Sketched values a round and the sketch's accuracy (rank error at most 1 / ACCURACY of the values).
GRID, ACCURACY = 256, 10_000
#: Bits of a value that a pass of ``array_quantiles`` settles.
RADIX = 11


def _null_safe(left: DataFrame, right: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    cond = F.lit(True)
    for k in by:
        cond = cond & left[k].eqNullSafe(right[k])
    return left.join(right, cond, how)


def _with(rows: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of the groups in ``small``, with its other columns."""
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") for k in by], *[c for c in small.columns if c not in by])
    cond = F.lit(True)
    for k in by:
        cond = cond & rows[k].eqNullSafe(renamed[f"_k_{k}"])
    return rows.join(renamed, cond).drop(*[f"_k_{k}" for k in by])


def _ranks(n: Column, q: float) -> tuple[Column, Column, Column]:
    at = (n - 1) * F.lit(float(q))
    return at, F.floor(at).cast("long"), F.ceil(at).cast("long")


def values_at_ranks(rows: DataFrame, wanted: DataFrame, by: Sequence[str], limit: int = LIMIT) -> DataFrame:
    """``(by, r, v)``: the value of rank ``r`` (from 0, ascending) of each group's ``_x`` for the rows ``(by, n, r)`` of ``wanted``."""
    none = F.lit(None).cast("double")
    state = wanted.select(*by, "r", none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"),
                          F.lit(2.0 / ACCURACY).alias("slack"), none.alias("v")).checkpoint(eager=True)
    between = (F.col("lo").isNull() | (F.col("_x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_x") < F.col("hi")))
    keys = [*by, "r", "lo", "hi", "below", "inside", "slack"]
    done = []
    while True:
        done.append(state.where("v IS NOT NULL").select(*by, "r", "v"))
        open_ = state.where(F.col("v").isNull() & (F.col("inside") > limit))
        few = state.where(F.col("v").isNull() & (F.col("inside") <= limit)).select(*by, "r", "lo", "hi", "below")
        held = _with(rows, few, by).where(between)
        done.append(held.groupBy(*by, "r", "below").agg(F.sort_array(F.collect_list("_x")).alias("_s"))
                    .select(*by, "r", F.get("_s", (F.col("r") - F.col("below")).cast("int")).alias("v")))
        if open_.isEmpty():
            break
        grid = [i / GRID for i in range(GRID + 1)]
        sketch = _with(rows, open_.drop("v"), by).where(between).groupBy(*keys).agg(F.percentile_approx("_x", grid, ACCURACY).alias("_s"))
        share = (F.col("r") - F.col("below")) / F.col("inside")
        low = F.floor((share - F.col("slack")) * GRID).cast("int")
        high = F.ceil((share + 1 / F.col("inside") + F.col("slack")) * GRID).cast("int")
        cut = sketch.withColumns({"a": F.col("_s")[F.greatest(low, F.lit(0))], "b": F.col("_s")[F.least(high, F.lit(GRID))]}).drop("_s")
        x, a, b = F.col("_x"), F.col("a"), F.col("b")
        seen = _with(rows, cut, by).where(between).groupBy(*keys, "a", "b").agg(
            F.count_if(x < a).alias("c1"), F.count_if(x == a).alias("e1"), F.count_if((x > a) & (x < b)).alias("m"),
            F.count_if((x == b) & (b > a)).alias("e2"))
        r = F.col("r") - F.col("below")
        from_a, to_a, to_m = F.col("c1"), F.col("c1") + F.col("e1"), F.col("c1") + F.col("e1") + F.col("m")
        missed = (r < from_a) | (r >= to_m + F.col("e2"))       # beyond the sketch's bound: again, with more room
        inner = (r >= to_a) & (r < to_m)
        state = seen.select(
            *by, "r", F.when(inner, a).otherwise(F.col("lo")).alias("lo"), F.when(inner, b).otherwise(F.col("hi")).alias("hi"),
            F.when(inner, F.col("below") + to_a).otherwise(F.col("below")).alias("below"), F.when(inner, F.col("m")).otherwise(F.col("inside")).alias("inside"),
            F.when(missed, F.col("slack") * 8).otherwise(F.col("slack")).alias("slack"),
            F.when(~missed & ~inner, F.when(r < to_a, a).otherwise(b)).alias("v")).checkpoint(eager=True)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float], name: str = "_q", limit: int = LIMIT) -> DataFrame:
    """``(keys, name)``: array of the exact quantiles ``qs`` of ``col`` per group (one row without keys), as
    ``percentile`` gives them. NULLs take no part; a group without values gives NULL."""
    rows = df.select(*keys, F.lit(0).alias("_all"), F.col(col).cast("double").alias("_x"))
    by = [*keys, "_all"]
    plain = lambda d, *g: d.groupBy(*g).agg(F.percentile("_x", list(qs)).alias(name))
    large = rows.groupBy(*by).agg(F.count("_x").alias("n")).where(F.col("n") > limit)
    if large.isEmpty():
        return plain(rows, *keys)
    large = large.checkpoint(eager=True)
    rest = plain(_null_safe(rows, large, by, "left_anti"), *by).select(*keys, name)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(lo, hi) for _, lo, hi in (_ranks(F.col("n"), q) for q in qs)])))
    found = values_at_ranks(rows.where("_x IS NOT NULL"), large.select(*by, "n", F.explode(ranks).alias("r")), by, limit)
    found = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("_v"))
    both = _with(large, found, by)

    def quantile(q: float) -> Column:
        at, lo, hi = _ranks(F.col("n"), q)
        u, v = F.col("_v")[lo], F.col("_v")[hi]
        return F.when((lo == hi) | (u == v), u).otherwise((hi - at) * u + (at - lo) * v)

    return both.select(*keys, F.array(*[quantile(q) for q in qs]).alias(name)).unionByName(rest)


def quantile_rounds(n: int, limit: int = LIMIT) -> int:
    """Rounds that ``n`` distinct values take at most: each leaves about four of ``GRID`` intervals."""
    return max(0, math.ceil(math.log(max(1.0, n / limit)) / math.log(GRID / 4)))


def _keys(x: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, NaN last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _values(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys ^ np.uint64(1 << 63), ~keys).view(float)


def array_quantiles(rows: DataFrame, n_features: int, levels: Sequence[float], most: int = 1 << 17) -> list[np.ndarray]:
    """The values at the ranks ``ceil(level n)`` of every place of the array ``x``, NULL left out, NaN last.

    The rows are read once: each task leaves the distinct values of ``most`` rows and their counts, in order. On these,
    the values at the ranks are found a few bits at a time, from counts whose number follows the levels alone."""

    def counted(batches):
        held, size = [], 0

        def distinct():
            for j in range(n_features):
                x = np.concatenate([x[~none[:, j], j] for x, none in held])
                keys, n = np.unique(_keys(x), return_counts=True)
                yield [j, size if j == 0 else 0, keys.tobytes(), n.astype(float).tobytes()]

        def sent():
            columns = [pa.array(v, t) for v, t in zip(zip(*distinct()), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["j", "m", "v", "n"])

        for rb in batches:
            if rb.num_rows:
                x = rb.column(0)
                held.append((matrix(x), x.flatten().is_null().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)))
                size += rb.num_rows
                if size >= most:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    data = rows.select("x").mapInArrow(counted, "j int, m int, v binary, n binary").checkpoint(eager=True)
    data = data.coalesce(max(1, -(-(data.agg(F.sum("m")).first()[0] or 0) // (4 * most))))
    known, wanted, bits = [(j, 0) for j in range(n_features)], None, 64
    while bits:
        take = bits % RADIX or RADIX
        bits -= take

        def counts(rb, known=known, bits=bits, take=take):
            out = np.zeros((len(known), 1 << take))
            for j, v, n in zip(*(rb.column(c).to_pylist() for c in (0, 2, 3))):
                v, n = np.frombuffer(v, np.uint64), np.frombuffer(n)
                cells = v >> np.uint64(bits)
                for i, (f, prefix) in enumerate(known):
                    if f == j:
                        a = np.searchsorted(cells, np.uint64(prefix << take), "left")
                        b = np.searchsorted(cells, np.uint64((prefix + 1 << take) - 1), "right")
                        out[i] += np.bincount((cells[a:b] & np.uint64((1 << take) - 1)).astype(np.intp), n[a:b], 1 << take)
            return out.ravel()

        total = summed(data, counts, len(known) << take).reshape(len(known), -1).cumsum(axis=1)
        if wanted is None:                                                  # (feature, prefix) and the ranks looked for in it
            wanted = {(j, 0): [max(1.0, float(np.ceil(q * total[j, -1]))) for q in levels] if total[j, -1] else [] for j, _ in known}
        found: dict[tuple[int, int], list[float]] = {}
        for (j, prefix), up_to in zip(known, total):
            for r in wanted[j, prefix]:
                c = int(np.searchsorted(up_to, r, "left"))
                found.setdefault((j, (prefix << take) + c), []).append(r - (up_to[c - 1] if c else 0.0))
        known, wanted = list(found), found
        if not known:
            return [np.array([]) for _ in range(n_features)]
    return [_values(np.sort(np.array([key for (f, key), ranks in wanted.items() if f == j for _ in ranks], np.uint64))) for j in range(n_features)]
