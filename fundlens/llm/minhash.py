"""Near-duplicate detection with HyperMinHash sketches.

1. A document's distinct word shingles give a sketch of registers; each
   holds the leading-zero count of a minimum hash and the mantissa bits that
   follow it. Documents with the same shingle set form one class at once.
2. Registers are banded; classes that share a band key meet in a bucket.
   Buckets are never expanded into pairs: each has one pivot, and its members
   are paired with the pivot only.
3. A pair's Jaccard similarity is estimated from equal registers, corrected
   for registers that agree by chance; pairs far below the threshold go.
4. The rest are verified on the full shingle sets; verified links form
   components. Where members of a bucket ended in another component than its
   pivot, its members are settled by an exact prefix filter between components,
   whatever the bucket's size (``_open_pairs``).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import CHUNK_BYTES, Scratch, arrow_map, c, mix64, span_hashes, text_steps, written
from fundlens.llm.graph import components

MANTISSA = 10     # bits kept behind the leading one
ROWS = 4          # registers of a band
MISS = 3e-6       # chance that a pair right at the threshold shares no band

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold ** ROWS))


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[k:] >> np.uint64(32)).astype(np.uint32)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words start."""
    low = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[low], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[edge] = inside[1:-1][edge]                   # a text's first byte starts a word
    last[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return span_hashes(low, starts, ends), np.searchsorted(starts, offs)


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: ``size`` words; with
    fewer words the whole sequence is one shingle; without words none."""
    h, at = words(data, offs)
    factors = mix64(np.arange(11, 11 + size, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size if len(full) else 0):
        full += h[k:k + len(full)] * factors[k]
    full = mix64(full)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a:b - size + 1]))
        elif b > a:
            short = (h[a:b] * factors[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(sets: list[np.ndarray], k: int) -> np.ndarray:
    """HyperMinHash registers ``(len(sets), k)`` of non-empty sets."""
    mult, add = _family(k)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    seg = np.cumsum([0] + [len(s) for s in sets[:-1]])
    low = np.empty((k, len(sets)), np.uint32)
    t = np.empty_like(x)
    for j in range(k):
        np.multiply(x, mult[j], out=t)
        t += add[j]
        np.minimum.reduceat(t, seg, out=low[j])
    _, bits = np.frexp(low.astype(np.float64))
    zeros = 32 - bits                                  # leading zeros of each minimum
    rest = (low.astype(np.uint64) << (zeros + 1).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
    return ((zeros.astype(np.uint16) << MANTISSA) | (rest >> np.uint64(32 - MANTISSA)).astype(np.uint16)).T


def chance_table() -> np.ndarray:
    """Probability that two different minima of sets of ``2^i`` elements give
    the same register, for i = 0 .. 31."""
    zeros = np.arange(0, 32)[:, None]
    cell = np.arange(1 << MANTISSA)[None, :]
    lo = 2.0 ** -(zeros + 1) * (1 + cell / (1 << MANTISSA))
    hi = lo + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
    return np.array([np.square(np.exp(n * np.log1p(-lo)) - np.exp(n * np.log1p(-np.minimum(hi, 1 - 1e-12)))).sum()
                     for n in 2.0 ** np.arange(32)])


def _profiles(df: DataFrame, size: int, k: int | None) -> DataFrame:
    """``(doc_id, row_key, n, digest, regs | elements)`` of ``(doc_id, text, row_key)``."""
    tail = "regs binary" if k else "elements array<long>"

    def run(batches):
        for rows, data, offs in text_steps(batches, "text", CHUNK_BYTES):
            sets = shingles(data, offs, size)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            ids = rows.column(rows.schema.get_field_index("doc_id"))
            out = {"doc_id": ids, "row_key": rows.column(rows.schema.get_field_index("row_key")), "n": pa.array([len(s) for s in sets], pa.int64()), "digest": pa.array(digest, pa.binary())}
            if k:
                full = [s for s in sets if len(s)]
                regs = iter(sketch(full, k) if full else ())
                out["regs"] = pa.array([next(regs).tobytes() if len(s) else None for s in sets], pa.binary())
            else:
                offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                out["elements"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.record_batch(out)

    return arrow_map(df.select("doc_id", "row_key", "text"), run, f"doc_id long, row_key long, n long, digest binary, {tail}")


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose corrected estimate is at least ``least``."""
    chance = chance_table()

    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            matrix = lambda name: np.frombuffer(b"".join(rb.column(name).to_pylist()), np.uint16).reshape(rb.num_rows, -1)
            equal = (matrix("regs_a") == matrix("regs_b")).mean(axis=1)
            size = np.minimum(rb.column("n_a").to_numpy(), rb.column("n_b").to_numpy())
            by_chance = chance[np.minimum(31, np.log2(size).astype(int))]
            est = (equal - by_chance) / (1 - by_chance)
            keep = pa.array(est >= least)
            yield pa.record_batch({"a": rb.column("a"), "b": rb.column("b"), "est": pa.array(est)}).filter(keep)

    return arrow_map(pairs.select("a", "b", "n_a", "n_b", "regs_a", "regs_b"), run, "a binary, b binary, est double")


class _Search:
    """One run of ``near_dedup``: its class table and how pairs are tested."""

    def __init__(self, docs: DataFrame, classes: DataFrame, size: int, percent: int, k: int, scratch: Scratch):
        self.docs, self.classes, self.size, self.percent, self.scratch = docs, classes, size, percent, scratch
        t = percent / 100
        self.least = t - 6 * math.sqrt(t * (1 - t) / k)

    def estimate(self, pairs: DataFrame) -> DataFrame:
        """Distinct ``(a, b)`` with sizes and sketches that allow a link."""
        side = lambda s: self.classes.select(F.col("digest").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"regs_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        # the smaller set over the larger is the most the similarity can be
        both = both.where(100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b"))
        return _estimated(both, self.least)

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """``(digest, elements)``: the full shingle sets of classes ``node``."""
        ids = nodes.join(self.classes.select(F.col("digest").alias("node"), "rep"), "node").select(F.col("rep").alias("_rep")).distinct()
        texts = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["_rep"]), "left_semi")
        # a row that occurs many times is one set
        return self.scratch.written(_profiles(texts, self.size, None).where("n > 0").groupBy("digest")
                                    .agg(F.first("elements").alias("elements")), "sets")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs that are links on their full shingle sets."""
        mine = sets.select(F.col("digest").alias("b"), F.col("elements").alias("set_b"))
        other = sets.select(F.col("digest").alias("a"), F.col("elements").alias("set_a"))
        both = pairs.select("a", "b").join(mine, "b").join(other, "a")
        inter = F.size(F.array_intersect("set_a", "set_b"))
        both = both.select("a", "b", inter.alias("i"), (F.size("set_a") + F.size("set_b")).alias("s"))
        return self.scratch.written(both.where(100 * F.col("i") >= self.percent * (F.col("s") - F.col("i"))).select("a", "b").distinct(), "edges")


def _open_pairs(nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``(a, b)``, with repeats: pairs of ``nodes`` (node, root) of different
    roots that can be links, by an exact prefix filter.

    Two sets x and y, x not the smaller, are a link only if they share
    percent * (|x| + |y|) / (100 + percent) shingles. What they share occurs
    under several roots: only such shingles count, in one order for all sets,
    rare ones first. From the first shared one on, x and y must each have that
    many left. As |y| <= |x|, this leaves y few shingles to be met under, in
    the class of its size, and a shingle of x gives the largest |y| and so the
    classes to look into. Copies that are linked already have one root and
    are not joined at all; sets with many shingles of their own have too few left.
    """
    numbers = scratch.written(nodes.select("root").distinct().select("root", F.monotonically_increasing_id().alias("r")), "roots")
    own = nodes.join(numbers, "root").join(sets.select(F.col("digest").alias("node"), F.col("elements").alias("e")), "node")
    items = scratch.written(own.select("node", "r", F.size("e").cast("long").alias("n"), F.explode("e").alias("s")), "items")
    common = (items.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("r").alias("lo"), F.max("r").alias("hi"))
              .where("lo != hi").select("s", "c"))
    per_set = Window.partitionBy("node")
    placed = items.join(common, "s").withColumns({"at": F.row_number().over(per_set.orderBy("c", "s")),
                                                  "more": F.count(F.lit(1)).over(per_set)})
    placed = scratch.written(placed.select("node", "r", "n", "s", (F.col("more") - F.col("at") + 1).alias("left")), "placed")
    step = math.log(100 / percent) / 8 if percent < 100 else 1.0
    size_class = lambda n: F.floor(F.log(n.cast("double")) / step).cast("int")      # noqa: E731
    least = F.ceil(percent * F.col("n") / 100)
    most = F.least(F.col("n"), F.floor((100 + percent) * F.col("left") / percent) - F.col("n"))
    x = (placed.select("node", "r", "n", "s", "left", least.alias("least"), most.alias("most")).where("least <= most")
         .select(F.col("node").alias("a"), F.col("r").alias("r_a"), F.col("n").alias("n_a"), "s", F.col("left").alias("left_a"), "least", "most",
                 F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("most")))).alias("g")))
    y = (placed.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))
         .select(F.col("node").alias("b"), F.col("r").alias("r_b"), F.col("n").alias("n_b"), "s", F.col("left").alias("left_b"), size_class(F.col("n")).alias("g")))
    return (x.join(y, ["s", "g"])
            .where((F.col("r_a") != F.col("r_b")) & F.col("n_b").between(F.col("least"), F.col("most"))
                   & ((100 + percent) * F.col("left_b") >= percent * (F.col("n_a") + F.col("n_b"))))
            .select("a", "b"))


def _labelled(df: DataFrame, key: str, labels: DataFrame | None, out: str) -> DataFrame:
    if labels is None:
        return df.withColumn(out, F.col(key))
    lab = labels.select(F.col("node").alias(key), F.col("root").alias("_root"))
    return df.join(lab, key, "left").withColumn(out, F.coalesce("_root", key)).drop("_root")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
               percent: int = 80, row_key: str | None = None) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per input row, and
    under the name ``row_key`` (if given) ``xxhash64(id, text)`` as a handle
    of the row.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's
    set holds its distinct ``size``-word shingles, or its whole word sequence
    if it has fewer words. Two documents are linked if 100 * intersection >=
    ``percent`` * union; ``component_id`` is the smallest id reachable, and
    the row with that id is kept.

    * a null text, an empty text or one without words has an empty set, is
      linked with nothing and is its own component;
    * documents with equal sets are one class, however many there are;
    * rows repeated under one id are separate rows with equal results if
      their texts are equal; a null id is never a component's id unless all
      its members' ids are null, and then one of their texts is kept;
    * other columns (whatever their names) are ignored; an empty table gives
      an empty result.

    Ids are integers.
    """
    k = bands_for(percent / 100) * ROWS
    docs = df.select(c(id_col).cast("long").alias("doc_id"), c(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    profiles = written(_profiles(docs, size, k), "profiles")
    scratch = Scratch()
    classes = scratch.written(profiles.where("digest IS NOT NULL").groupBy("digest")
                      .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    search = _Search(docs, classes, size, percent, k, scratch)

    band = classes.select("digest", "regs", F.explode(F.sequence(F.lit(0), F.lit(k // ROWS - 1))).alias("band"))
    rows = band.select(F.xxhash64("band", F.substring(F.col("regs"), F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key"),
                       F.col("digest").alias("node"))
    sizes = scratch.written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    met = scratch.written(rows.join(sizes, "key"), "met")
    # pivot: the member that shares its buckets with most others, as the original of a group of copies does
    score = scratch.written(met.groupBy("node").agg(F.sum("m").alias("score")), "score")
    pivots = scratch.written(met.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("p"))
                     .select("key", F.col("p.node").alias("pivot")), "pivots")
    met = scratch.written(met.select("key", "node").join(pivots, "key"), "met")
    pairs = met.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    likely = scratch.written(search.estimate(pairs).join(score.withColumnRenamed("node", "a"), "a"), "likely")
    sets = search.sets_of(likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct())

    # first each member with one pivot, then the pairs that this leaves between components
    first = F.min(F.struct((F.col("est") < percent / 100).alias("low"), (-F.col("score")).alias("order"), "a"))
    one = scratch.written(likely.groupBy("b").agg(first.alias("x")).select(F.col("x.a").alias("a"), "b"), "pairs")
    edges = search.verify(one, sets)
    labels = components(edges, scratch)
    rest = _labelled(_labelled(likely, "a", labels, "root_a"), "b", labels, "root_b").where("root_a != root_b")
    more = search.verify(rest.join(one, ["a", "b"], "left_anti"), sets)
    if not more.isEmpty():
        edges = edges.union(more)
        labels = components(edges, scratch)

    # Buckets whose members ended in several components: of two unlinked members one at least is outside the
    # pivot's component.
    placed = _labelled(_labelled(met, "node", labels, "root"), "pivot", labels, "pivot_root")
    placed = scratch.written(placed.select("key", "node", "root", (F.col("root") != F.col("pivot_root")).alias("minor")), "minor")
    open_keys = placed.where("minor").select("key").distinct()
    if not open_keys.isEmpty():
        nodes = scratch.written(placed.join(open_keys, "key", "left_semi").select("node", "root").distinct(), "members")
        sets = search.sets_of(nodes.select("node"))
        pairs = _open_pairs(nodes, sets, percent, scratch)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tested = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = search.verify(search.estimate(pairs.join(tested, ["a", "b"], "left_anti")), sets)
        if not more.isEmpty():
            labels = components(edges.union(more), scratch)

    rooted = _labelled(classes.select("digest", "rep"), "digest", labels, "root")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = written(rooted.join(least, "root").select("digest", "component_id", (F.col("digest") == F.col("root")).alias("first")), "components")
    scratch.discard()
    out = profiles.select("doc_id", "row_key", "n", "digest").join(final, "digest", "left")
    comp = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      (F.col("doc_id").eqNullSafe(comp) & (comp.isNotNull() | F.coalesce("first", F.lit(True)))).alias("kept"),
                      *([F.col("row_key").alias(row_key)] if row_key else []))
