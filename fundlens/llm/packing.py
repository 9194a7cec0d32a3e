"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents are encoded and cut into full sequences and one remainder each. The
histogram of remainder lengths (at most ``capacity`` entries, whatever the
corpus size) is the demand of a cutting-stock problem: a pattern says how many
pieces of which lengths share a sequence. A linear program over patterns is
solved by column generation; a knapsack dynamic program prices new patterns
with the dual values. Pattern counts are rounded down, the few pieces left are
packed by subset sums, and the plan is applied to the pieces by their rank
among those of equal length: rank ranges map to sequence and offset.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import arrow_map, c, partitions, text_steps, written
from fundlens.llm.words import LIMIT, WordEncoder

STEP = 1 << 19
#: Column generation ends when its dual bound proves the plan to be within this share of the optimum.
GAP = 1e-3
#: Exchanges after which it ends unproved (a pricing takes about 10 ms at a capacity of 2048).
PIVOTS = 5000


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    """The library's encoder behind a store of words, one per Python worker."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")       # a task has one core
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    specials = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    suffix = json.loads(tok.to_str())["model"].get("end_of_word_suffix")
    last = np.zeros(max([*tok.get_vocab().values(), *specials.values()], default=0) + 1, bool)
    if suffix:
        last[[i for t, i in tok.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True

    def apart(words: list[str]) -> list[list[int]]:
        return [e.ids for e in tok.encode_batch_fast(words, add_special_tokens=False)]

    def encode(words: list[str]) -> list[list[int]]:
        # words below U+0250 as one text, each ending at its token with the suffix; few at a time: an encoding holds far more than its ids
        out = []
        for k in range(0, len(words), 4096):
            some = words[k:k + 4096]
            text = " ".join(some)
            if not suffix or len(some) < 2 or max(text) >= chr(LIMIT):
                out += apart(some)
                continue
            [ids] = apart([text])
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            out += [ids[a:b] for a, b in zip([0, *ends], ends)] if len(ends) == len(some) else apart(some)
        return out

    return WordEncoder(encode, specials)


# --- the plan (driver, bounded by the capacity) ---------------------------------------------------------------------
def _first_patterns(lengths: list[int], demand: list[float], capacity: int):
    """Greedy fractional filling, largest first: one pattern per length, each
    using up one length. The patterns are a basis with non-negative values."""
    left = dict(zip(lengths, map(float, demand)))
    alive = sorted(lengths)
    out = []
    while alive:
        room, pattern = capacity, {}
        while (k := bisect_right(alive, room)):
            size = alive[k - 1]
            pattern[size] = room // size
            room -= size * pattern[size]
        x = min(left[s] / a for s, a in pattern.items())
        gone = min((s for s, a in pattern.items() if left[s] / a <= x), key=lambda s: -s)
        for s, a in pattern.items():
            left[s] = max(0.0, left[s] - a * x)
        left[gone] = 0.0
        alive.remove(gone)
        out.append((pattern, x))
    return out


def _price(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """Most valuable pattern: unbounded knapsack by dynamic programming."""
    useful = value > 1e-12
    size, worth = lengths[useful], value[useful]
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(size, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            got = best[room - size[:fits[room]]] + worth[:fits[room]]
            k = int(got.argmax())
            if got[k] > best[room]:
                best[room], take[room] = got[k], k
    pattern: dict[int, int] = {}
    room = capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
            continue
        s = int(size[take[room]])
        pattern[s] = pattern.get(s, 0) + 1
        room -= s
    return float(best[capacity]), pattern


def solve_patterns(histogram: dict[int, int], capacity: int, gap: float = GAP, pivots: int = PIVOTS, trace: list | None = None):
    """Fractional plan ``[(pattern, multiplicity)]`` by column generation.

    Each pricing of the current dual values bounds every plan from below: by
    the plan over the priced pattern's worth, and by the dual values
    ``length / capacity``, which no pattern prices above 1. The best bound so
    far ends the generation. ``trace`` collects ``(plan, bound)`` of every pricing."""
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(s)] for s in lengths], float)
    m = len(lengths)
    if not m:
        return []
    row = {int(s): i for i, s in enumerate(lengths)}
    patterns, x = map(list, zip(*_first_patterns([int(s) for s in lengths], list(demand), capacity)))
    least = float(lengths @ demand) / capacity                    # no plan can use fewer sequences
    basis = np.zeros((m, m))
    for t, p in enumerate(patterns):
        for s, a in p.items():
            basis[row[s], t] = a
    inverse = np.linalg.inv(basis)
    x = np.maximum(inverse @ demand, 0.0)
    bound = least
    for _ in range(pivots):
        total = x.sum()
        dual = inverse.sum(axis=0)
        worth, pattern = _price(lengths, dual, capacity)
        bound = max(bound, total / max(worth, 1.0))
        if trace is not None:
            trace.append((float(total), float(bound)))
        if total <= bound * (1 + gap):
            break
        column = np.zeros(m)
        for s, a in pattern.items():
            column[row[s]] = a
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0.0)
        x[out] = ratio[out]
        pivot_row = inverse[out] / step[out]
        step[out] = 0.0
        hit = np.flatnonzero(pivot_row)                           # the inverse is sparse
        inverse[:, hit] -= np.outer(step, pivot_row[hit])
        inverse[out] = pivot_row
        patterns[out] = pattern
    return [(p, float(v)) for p, v in zip(patterns, x) if v > 1e-9]


def _fill(left: dict[int, int], sizes: list[int], capacity: int) -> dict[int, int]:
    """Largest piece first, then a subset sum of the others that fills the rest best."""
    pattern = {sizes[-1]: 1}
    room = capacity - sizes[-1]
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for s in sizes[bisect_right(sizes, room) - 1::-1] if bisect_right(sizes, room) else []:
        for _ in range(min(left[s] - pattern.get(s, 0), room // s)):
            steps.append((s, reach))
            reach |= (reach << s) & mask
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for s, before in reversed(steps):
        if not before >> at & 1:
            pattern[s] = pattern.get(s, 0) + 1
            at -= s
    return pattern


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns ``[(pattern, sequences)]`` that use every piece once."""
    left = {int(s): int(n) for s, n in histogram.items() if n > 0 and s > 0}
    out = []
    if left.get(capacity):
        out.append(({capacity: 1}, left.pop(capacity)))
    for pattern, x in solve_patterns(left, capacity):
        times = min([int(x + 1e-6)] + [left[s] // a for s, a in pattern.items()])
        if times > 0:
            out.append((pattern, times))
            for s, a in pattern.items():
                left[s] -= a * times
    sizes: list[int] = []
    for s, n in left.items():
        if n:
            insort(sizes, s)
    while sizes:
        pattern = _fill(left, sizes, capacity)
        times = min(left[s] // a for s, a in pattern.items())
        out.append((pattern, times))
        for s, a in pattern.items():
            left[s] -= a * times
            if not left[s]:
                sizes.remove(s)
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, first rank, end rank, pieces per sequence, first sequence,
    offset in it)`` for every pattern and length."""
    rank: dict[int, int] = {}
    sequence, out = 0, []
    for pattern, times in patterns:
        offset = 0
        for s in sorted(pattern, reverse=True):
            a = pattern[s]
            lo = rank.get(s, 0)
            rank[s] = lo + a * times
            out.append((s, lo, rank[s], a, sequence, offset))
            offset += a * s
        sequence += times
    return out


# --- Spark side -----------------------------------------------------------------------------------------------------
def token_pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
                 end_id: int = 1) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: each document's ids
    and the end id, cut into full sequences and a remainder."""
    rows = df.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))

    def run(batches):
        encoder = _encoder(path)
        tail = np.array([end_id], "<u4")
        for part, data, offs in text_steps(batches, "text", STEP):
            ids, at = encoder.texts(data, offs)
            who, start, length, crc, total = [], [], [], [], []
            for i in range(part.num_rows):
                doc = np.concatenate([ids[at[i]:at[i + 1]], tail]).astype("<u4")
                n = len(doc)
                view = memoryview(doc.view(np.uint8))
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    who.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(view[4 * s:4 * e]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(who, pa.int64())), *[pa.array(v, pa.int64()) for v in (start, length, crc, total)]],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow_map(rows, run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (column ``length`` from 1 to ``capacity``) with
    ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    parts = partitions(spark)
    # equal lengths are ranked in salted groups, so that a frequent length is many tasks' work
    pieces = written(pieces.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), "packing")
    groups = written(pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "packing")
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_salt").orderBy(*[x for x in ("doc_id", "start") if x in pieces.columns] or ["length"])
    ranked = (pieces.withColumn("_at", F.row_number().over(inside) - 1).join(bases, ["length", "_salt"])
              .withColumn("_rank", F.col("_base") + F.col("_at")))
    # at most a few entries per length and pattern: the number of patterns is bounded by the capacity
    table = spark.createDataFrame(slots(plan(histogram, capacity)),
                                  "_len long, _lo long, _hi long, _per long, _seq long, _off long")
    placed = ranked.join(F.broadcast(table), (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo"))
                         & (F.col("_rank") < F.col("_hi")))
    k = F.col("_rank") - F.col("_lo")
    out = placed.withColumns({"sequence_id": F.col("_seq") + F.expr("(_rank - _lo) div _per"),
                              "offset": F.col("_off") + F.pmod(k, F.col("_per")) * F.col("length")})
    return out.select(*[c(x) for x in pieces.columns if x != "_salt"], "sequence_id", "offset")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
         end_id: int = 1) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``,
    one row per piece; pieces of a sequence lie gapless from offset 0.

    * a null or empty text is the end id alone;
    * repeated rows and ids are documents of their own; null ids are kept;
    * other columns (whatever their names) are ignored; an empty table gives
      an empty result. Ids are integers.
    """
    pieces = token_pieces(df, path, id_col, text_col, capacity, end_id)
    return pack_pieces(pieces, capacity).withColumnRenamed("doc_id", id_col)
