"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces that fill a sequence stand alone. The others are dealt at random into
problems of about ``GROUP`` pieces, whatever the corpus holds, and every
problem is evolved on several islands. An individual is a set of bins, and
genes are whole bins:

* crossover injects well-filled bins of one parent into the other; bins that
  hold a piece twice then go, and the pieces that they leave behind are put
  back by best fit, largest first;
* mutation dissolves the emptiest bins and puts their pieces back likewise;
* fitness is the number of bins, then the sum of squared fills, which prefers
  one nearly empty bin to several half-empty ones.

Between epochs the best individuals of an island migrate to the next one of
the same problem: a join of the written states. The best individual of all
islands wins. Its bins that are full, or nearly so, are final; the pieces of
the rest are dealt anew, into fewer problems, until one problem holds them
all or a round no longer settles half of them.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.common import Scratch, arrow_map, c, written
from fundlens.llm.packing import token_pieces

#: Pieces of a problem on average.
GROUP = 512
#: Islands of a problem, epochs (a migration lies between two), individuals of an island, children an epoch.
ISLANDS, EPOCHS, POPULATION, CHILDREN = 3, 2, 6, 16
#: Individuals that migrate.
ELITE = 2
#: A bin is final when its free room is at most this share of it (or in the last round).
SLACK = 1 / 256

Bins = list[list[int]]


def best_fit(items: Sequence[int], sizes: Sequence[int], bins: Bins, room: list[int], capacity: int) -> None:
    """Put ``items`` (in this order) where they leave the least room; ``bins`` and ``room`` grow in place, the
    lists in ``bins`` are replaced, never changed (individuals share them)."""
    tight = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        size = sizes[i]
        k = bisect_left(tight, (size, -1))
        if k == len(tight):
            left, b = capacity, len(bins)
            bins.append([])
            room.append(capacity)
        else:
            left, b = tight.pop(k)
        left -= size
        bins[b] = [*bins[b], i]
        room[b] = left
        if left:
            insort(tight, (left, b))


class Individual:
    """Bins of item numbers, the room left in each, and the fitness (larger is better)."""

    __slots__ = ("bins", "room", "fitness")

    def __init__(self, bins: Bins, room: list[int], capacity: int):
        self.bins, self.room = bins, room
        self.fitness = (-len(bins), sum((capacity - r) ** 2 for r in room))

    @staticmethod
    def packed(order: Sequence[int], sizes: Sequence[int], capacity: int) -> Individual:
        bins: Bins = []
        room: list[int] = []
        best_fit(order, sizes, bins, room, capacity)
        return Individual(bins, room, capacity)

    @staticmethod
    def of(places: Sequence[int], sizes: Sequence[int], capacity: int) -> Individual:
        """From the bin number of each item."""
        bins: Bins = [[] for _ in range(max(places, default=-1) + 1)]
        for i, b in enumerate(places):
            bins[b].append(i)
        return Individual(bins, [capacity - sum(sizes[i] for i in b) for b in bins], capacity)

    def places(self, n: int) -> list[int]:
        out = [0] * n
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    def perfect(self) -> bool:
        """No better fitness is possible: all bins but one are full."""
        return sum(r > 0 for r in self.room) <= 1


def crossover(into: Individual, giver: Individual, sizes: Sequence[int], capacity: int, rnd: random.Random) -> Individual:
    """A child: well-filled bins of ``giver`` whole, the bins of ``into`` that they leave untouched but for the
    emptiest few (mutation), and all other pieces by best fit."""
    ranked = sorted(range(len(giver.bins)), key=giver.room.__getitem__)
    well = ranked[:max(1, len(ranked) // 2)]
    chosen = [b for b in well if rnd.random() < 0.5] or well[:1]
    bins, room = [giver.bins[b] for b in chosen], [giver.room[b] for b in chosen]
    taken = {i for b in bins for i in b}
    displaced: list[int] = []
    kept = []
    for b, items in enumerate(into.bins):
        if taken.isdisjoint(items):
            kept.append(b)
        else:
            displaced += [i for i in items if i not in taken]
    kept.sort(key=into.room.__getitem__)
    for _ in range(rnd.randrange(1, 4)):
        if kept and into.room[kept[-1]]:                      # a full bin is never dissolved
            displaced += into.bins[kept.pop()]
    bins += [into.bins[b] for b in kept]
    room += [into.room[b] for b in kept]
    best_fit(sorted(displaced), sizes, bins, room, capacity)
    return Individual(bins, room, capacity)


def founders(sizes: Sequence[int], capacity: int, rnd: random.Random, most: int) -> list[Individual]:
    """The first individuals of an island: best fit, largest first, and best fit in shaken orders."""
    n = len(sizes)
    out = [Individual.packed(range(n), sizes, capacity)]
    for _ in range(most - 1):
        shake = rnd.uniform(0.1, 0.6)
        order = sorted(range(n), key=lambda i: -sizes[i] * (1 - shake * rnd.random()))
        out.append(Individual.packed(order, sizes, capacity))
    return out


def evolve(sizes: Sequence[int], capacity: int, population: list[Individual], seed: str, most: int = POPULATION,
           children: int = CHILDREN) -> list[Individual]:
    """One epoch of an island; the population, best first. ``sizes`` fall. The best individual is never lost."""
    rnd = random.Random(seed)
    population = population or founders(sizes, capacity, rnd, most)
    population = sorted(population, key=lambda x: x.fitness, reverse=True)[:most]
    for _ in range(children):
        if population[0].perfect():
            break
        pick = lambda: population[min(rnd.randrange(len(population)), rnd.randrange(len(population)))]  # noqa: E731  tournament of two
        child = crossover(pick(), pick(), sizes, capacity, rnd)
        if all(child.fitness != x.fitness for x in population):
            insort(population, child, key=lambda x: (-x.fitness[0], -x.fitness[1]))
            del population[most:]
    return population


# --- Spark side -----------------------------------------------------------------------------------------------------
_STATE = "problem long, island int, sizes array<int>, population array<array<int>>, n_bins int, fill long"


def _epoch(states: DataFrame, capacity: int, epoch: str) -> DataFrame:
    """Evolve every (problem, island) row; ``population`` holds the bin number of each piece, best individual first."""
    def run(batches):
        for rb in batches:
            out = []
            for row in rb.to_pylist():
                sizes = row["sizes"]
                now = [Individual.of(p, sizes, capacity) for p in [*(row["population"] or []), *(row["incoming"] or [])]]
                now = evolve(sizes, capacity, now, f"{row['problem']}/{row['island']}/{epoch}")
                out.append((row["problem"], row["island"], sizes, [x.places(len(sizes)) for x in now], len(now[0].bins), now[0].fitness[1]))
            cols = list(zip(*out))
            types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)],
                                             names=["problem", "island", "sizes", "population", "n_bins", "fill"])

    return arrow_map(states.select("problem", "island", "sizes", "population", "incoming"), run, _STATE)


def _laid_out(best: DataFrame, capacity: int) -> DataFrame:
    """``(problem, bins, offsets, rooms)``: per piece its bin, its offset there and the room that the bin has left."""
    def run(batches):
        for rb in batches:
            out = []
            for row in rb.to_pylist():
                used: dict[int, int] = {}
                offsets = []
                for size, b in zip(row["sizes"], row["places"]):
                    offsets.append(used.get(b, 0))
                    used[b] = offsets[-1] + size
                out.append((row["problem"], row["places"], offsets, [capacity - used[b] for b in row["places"]]))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(x, pa.list_(pa.int32())) for x in cols[1:]]],
                                             names=["problem", "bins", "offsets", "rooms"])

    return arrow_map(best, run, "problem long, bins array<int>, offsets array<int>, rooms array<int>")


def _round(pieces: DataFrame, names: list[str], problems: int, number: int, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces`` (with a unique ``_at``) dealt into ``problems`` and packed: with ``_bin``, ``offset``, ``_room``."""
    problem = F.pmod(F.xxhash64("_at", F.lit(number)), F.lit(problems))
    dealt = pieces.groupBy(problem.alias("problem")).agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("length")).alias("_order"), "_at", *[c(x) for x in names]))).alias("items"))
    dealt = scratch.written(dealt, "genetic-problems")
    sizes = F.transform("items", lambda x: x["length"].cast("int"))
    none = "array<array<int>>"
    states = dealt.select("problem", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), sizes.alias("sizes"),
                          F.lit(None).cast(none).alias("population"), F.lit(None).cast(none).alias("incoming"))
    states = states.repartition("problem", "island")                     # a few large rows: spread the evolution
    for epoch in range(EPOCHS):
        states = scratch.written(_epoch(states, capacity, f"{number}/{epoch}"), "genetic-epoch")
        if epoch + 1 < EPOCHS:
            elite = states.select("problem", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("population", 1, ELITE).alias("incoming"))
            states = states.join(elite, ["problem", "island"])
    best = states.groupBy("problem").agg(F.min_by(F.struct("sizes", F.col("population")[0].alias("places")),
                                                  F.struct("n_bins", -F.col("fill"), "island")).alias("b"))
    laid = scratch.written(_laid_out(best.select("problem", "b.sizes", "b.places"), capacity), "genetic-layout")
    each = dealt.join(laid, "problem").select("problem", F.explode(F.arrays_zip("items", "bins", "offsets", "rooms")).alias("x"))
    return each.select(*[F.col("x.items." + x).alias(x) for x in [*names, "_at"]], F.col("problem").alias("_problem"),
                       F.col("x.bins").alias("_bin"), F.col("x.offsets").cast("long").alias("offset"), F.col("x.rooms").alias("_room"))


def pack_pieces(pieces: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """``pieces`` (column ``length``, 1 to ``capacity``) with ``sequence_id`` (any distinct numbers) and ``offset``."""
    scratch = Scratch()
    names = [x for x in pieces.columns]
    rows = scratch.written(pieces.withColumn("_at", F.monotonically_increasing_id()), "genetic-pieces")
    alone = F.col("length") == capacity
    parts = [rows.where(alone).select(*names, (-1 - F.col("_at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    left, number, before = rows.where(~alone), 0, None
    n = left.count()
    while n:
        problems = max(1, -(-n // group))
        packed = scratch.written(_round(left, names, problems, number, capacity, scratch), "genetic-packed")
        settled = F.col("_room") <= int(capacity * SLACK)
        n, before = packed.where(~settled).count(), n
        last = problems == 1 or 2 * n > before
        final = packed if last else packed.where(settled)
        # a bin number is below the pieces of its problem, whose number is far below 2^20 (their mean is ``group``)
        sequence = F.lit(number << 57) + F.shiftleft(F.col("_problem"), 20) + F.col("_bin")
        parts.append(final.select(*names, sequence.cast("long").alias("sequence_id"), "offset"))
        if last:
            break
        left, number = packed.where(~settled).select(*names, "_at"), number + 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = written(out, "genetic")
    scratch.discard()
    return out


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1,
         group: int = GROUP) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece; the pieces of a sequence
    lie gapless from offset 0 and hold ``capacity`` ids at most.

    * a document is its ids and the end id; only a document above ``capacity`` is cut, into full pieces and a rest;
    * a null or empty text is the end id alone;
    * repeated rows and ids are documents of their own; null ids are kept;
    * other columns (whatever their names) are ignored; an empty table gives an empty result. Ids are integers.
    """
    pieces = token_pieces(df, path, id_col, text_col, capacity, end_id)
    pieces = pieces.select("doc_id", F.expr(f"cast(start div {capacity} as int)").alias("piece"), "start", "length", "ids_crc32")
    return pack_pieces(pieces, capacity, group).withColumnRenamed("doc_id", id_col)
