"""Exact substring deduplication by a column-wise multi-string construction.

Every byte covered by a ``width``-byte string that also starts anywhere else
is removed. The strings that can be equal are brought together first:

1. A window of ``width`` bytes has one anchor, the leftmost of its smallest
   ``GRAM``-byte hashes. Consecutive windows with one anchor form a *piece*
   (shorter than ``2 * width`` bytes, whatever the length of the text). Equal
   windows have equal anchors at equal offsets, so only pieces with the same
   anchor hash need to be compared. Anchors that occur once end here.
2. Equal pieces (by a 128-bit BLAKE2b digest) are one string with a count:
   all windows of a piece that occurs twice are repeated.
3. The distinct pieces of an anchor are a collection of strings aligned on
   it. Its Burrows-Wheeler transform is built column by column from the right:
   each round inserts one symbol of every string, stably re-sorts the
   suffixes by that symbol and updates the common prefix of neighbours. The
   columns are a sequential external file that is read once. Equal windows
   are suffixes of the same round, so the suffixes of a round are ordered
   among themselves; merging them with those of other rounds, which cannot
   hold an equal window, is left out. A window is repeated if it shares
   ``width`` symbols with a neighbour.
4. Anchors with more than ``MOST`` distinct pieces would make one task
   large; their windows are grouped by 128-bit hash instead, which is exact
   for any number.

Repeated windows become byte spans of their documents; the remaining bytes
are read from the text.
"""

from __future__ import annotations

import tempfile
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.llm.common import Scratch, arrow_map, c, lanes, mix64, partitions, powers, ragged, text_steps, written

GRAM = 32
#: Distinct pieces of one anchor that a task takes; beyond, windows are hashed.
MOST = 32768
#: Strings of one construction (whole anchors are added until this is reached).
BATCH = 8192
STEP = 1 << 19
#: Longer texts are cut for the anchor search, with an overlap of one window.
LONGEST = 1 << 23

#: Factors of the two halves of a window's hash.
_FACTORS = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def _prefix(data: np.ndarray, step: int, half: int) -> np.ndarray:
    """Prefix sums of ``value * base^i``; the value of a place is a mixed hash of the ``step`` bytes from there on."""
    n = max(0, len(data) - step + 1)
    value = mix64((lanes(data)[:n] & np.uint64((1 << 8 * step) - 1)) * np.uint64(_FACTORS[half]) + np.uint64(half + 1))
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(value * powers(n, base=half), out=out[1:])
    return out


def _span(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int, half: int) -> np.ndarray:
    """Hash of the bytes ``start:end``, at least ``step`` of them."""
    return mix64((prefix[ends - step + 1] - prefix[starts]) * powers(len(prefix), True, half)[starts])


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:len(x) - (n - span)], x[n - span:]) if n > span else x


def pieces(data: np.ndarray, offs: np.ndarray, width: int):
    """Pieces of the texts ``data[offs[i]:offs[i+1]]``: ``(text, start, length,
    anchor offset, anchor hash, and the two halves of the content's BLAKE2b digest)``."""
    gram = min(GRAM, width)
    sizes = np.diff(offs)
    starts = ragged(offs[:-1], np.maximum(0, sizes - width + 1))     # every window that lies in one text
    if not len(starts):
        return None
    n = len(data) - gram + 1
    step = min(8, gram)
    every = np.arange(n)
    grams = _span(_prefix(data, step, 0), every, every + gram, step, 0)
    place = np.uint64((1 << 24) - 1)                                 # smallest hash, then leftmost position
    low = _sliding_min((grams & ~place) | np.arange(n, dtype=np.uint64), width - gram + 1)
    anchor = (low[starts] & place).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - width + 1))
    head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    lo = starts[head]
    hi = starts[np.concatenate([head[1:] - 1, [len(starts) - 1]])] + width
    a, text = anchor[head], owner[head]
    view = memoryview(np.ascontiguousarray(data))
    content = b"".join([blake2b(view[s:e], digest_size=16).digest() for s, e in zip(lo.tolist(), hi.tolist())])
    content = np.frombuffer(content, "<u8").reshape(-1, 2)
    return text, lo - offs[text], hi - lo, a - lo, grams[a], content[:, 0].copy(), content[:, 1].copy()


def _cut(data: np.ndarray, offs: np.ndarray, width: int):
    """Cut texts over ``LONGEST`` bytes: ``(data, offsets, text, start in the text)`` of parts."""
    sizes = np.diff(offs)
    if not len(sizes) or sizes.max() <= LONGEST:
        yield data, offs, np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        return
    for i, n in enumerate(sizes.tolist()):
        for s in range(0, max(1, n - width + 1), LONGEST):
            part = data[offs[i] + s:min(offs[i] + s + LONGEST + width - 1, offs[i + 1])]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([s])


def _occurrences(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for rows, data, offs in text_steps(batches, "text", STEP):
            ids, keys = rows.column(0), rows.column(1)
            for part, part_offs, text, base in _cut(data, offs, width):
                got = pieces(part, part_offs, width)
                if got is None:
                    continue
                at, lo, n, off, anchor, g1, g2 = got
                take = pa.array(text[at])
                yield pa.record_batch({
                    "doc_id": ids.take(take), "tk": keys.take(take), "start": pa.array(lo + base[at]),
                    "len": pa.array(n.astype(np.int32)), "off": pa.array(off.astype(np.int32)),
                    "anchor": pa.array(anchor.view(np.int64)), "g1": pa.array(g1.view(np.int64)), "g2": pa.array(g2.view(np.int64))})

    return arrow_map(docs.select("doc_id", "tk", "text"), run, "doc_id long, tk long, start long, len int, off int, anchor long, g1 long, g2 long")


def repeated_windows(strings: np.ndarray, offs: np.ndarray, off: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """``flags[i, w]``: the window of string i that starts ``width - 1 - w``
    bytes before its anchor also occurs in another string of its group.

    ``group`` is sorted; string i is aligned at ``off[i]``."""
    n = len(off)
    left = width - 1
    size = np.diff(offs)
    lo, hi = -off, size - off
    columns = left + width
    text = np.zeros(columns * n, np.uint8)
    for a in range(0, n, 1024):                           # few strings at a time: an index takes 8 bytes a symbol
        b = min(n, a + 1024)
        part = strings[offs[a]:offs[b]]
        place = np.arange(len(part)) - np.repeat(offs[a:b] - offs[a] + off[a:b], size[a:b]) + left
        text[place * n + np.repeat(np.arange(a, b), size[a:b])] = part
    flags = np.zeros((width, n), bool)
    with tempfile.TemporaryFile() as file:                # columns, last one first: read in sequence
        text.reshape(columns, n)[::-1].tofile(file)
        del text
        file.seek(0)
        order = np.arange(n)
        edge = np.concatenate([[True], group[1:] != group[:-1]])     # group borders keep their places
        block = np.cumsum(edge) - 1
        first_of = np.flatnonzero(edge)
        differ = np.zeros(n, np.int64)                    # round in which a suffix last differed from the one above it
        for r in range(1, columns + 1):
            rel = width - r
            column = np.fromfile(file, np.uint8, n)
            inside = (lo <= rel) & (rel < hi)
            symbol = np.where(inside, column.astype(np.int16), np.int16(256))[order]
            step = symbol[1:] - symbol[:-1]
            fall = np.flatnonzero((step < 0) & ~edge[1:]) + 1
            if len(fall):
                # groups that are no longer in order: sort by (group, symbol), stably, and take the largest
                # "last differed" between the old places of the new neighbours
                mixed = np.zeros(len(first_of), bool)
                mixed[block[fall]] = True
                at = np.flatnonzero(mixed[block])
                key = block[at] * 257 + symbol[at]
                by = at[np.argsort(key, kind="stable")]
                above = np.concatenate([[0], by[:-1]])
                same = np.flatnonzero((symbol[by] == symbol[above]) & ~edge[at])
                new = np.full(len(at), r, np.int64)
                if len(same):
                    ends = np.empty(2 * len(same), np.int64)
                    ends[0::2], ends[1::2] = above[same] + 1, by[same] + 1
                    new[same] = np.maximum.reduceat(np.append(differ, 0), ends)[0::2]
                order[at] = order[by]
                symbol[at] = symbol[by]
                differ[at] = new
            apart = np.concatenate([[True], symbol[1:] != symbol[:-1]]) | edge | (symbol == 256)
            differ[apart] = r
            if rel <= 0:
                match = r - differ >= width
                if match.any():
                    hit = match.copy()
                    hit[:-1] |= match[1:]
                    flags[rel + left, order[hit]] = True
    return flags.T


def flagged_spans(flags: np.ndarray, off: np.ndarray, width: int):
    """Runs of flagged windows as byte spans of their strings: ``(string, lo, hi)``."""
    n = len(flags)
    wide = np.zeros((n, flags.shape[1] + 2), np.int8)
    wide[:, 1:-1] = flags
    turn = np.diff(wide, axis=1)
    who, begin = np.nonzero(turn == 1)
    _, end = np.nonzero(turn == -1)
    base = off[who] - (width - 1)
    return who, begin + base, end - 1 + base + width


def _compared(strings: DataFrame, width: int) -> DataFrame:
    """Spans ``(doc_id, tk, lo, hi)`` of the repeated windows of strings that
    occur once; rows arrive sorted by anchor."""

    def construct(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        body = t["body"].combine_chunks()
        if isinstance(body, pa.ChunkedArray):
            body = pa.concat_arrays(body.chunks)
        body = body.cast(pa.large_binary())
        offs = np.frombuffer(body.buffers()[1], np.int64)[body.offset:body.offset + len(body) + 1]
        data = np.frombuffer(body.buffers()[2], np.uint8)[offs[0]:offs[-1]]
        off = t["off"].to_numpy().astype(np.int64)
        flags = repeated_windows(data, offs - offs[0], off, t["anchor"].to_numpy(), width)
        flags[t["n"].to_numpy() > 1] = False                 # these are counted as wholes
        who, lo, hi = flagged_spans(flags, off, width)
        start = t["start"].to_numpy()[who]
        return pa.record_batch({"doc_id": t["doc_id"].combine_chunks().take(pa.array(who)) if t.num_rows else t["doc_id"],
                                "tk": t["tk"].combine_chunks().take(pa.array(who)),
                                "lo": pa.array(start + lo), "hi": pa.array(start + hi)})

    def run(batches):
        held, count = [], 0
        for rb in batches:
            if not rb.num_rows:
                continue
            anchors = rb.column(rb.schema.get_field_index("anchor")).to_numpy()
            if count >= BATCH:
                # flush at the first border of anchors
                last = held[-1].column(held[-1].schema.get_field_index("anchor"))[-1].as_py()
                cut = int(np.searchsorted(anchors, last, "right"))
                if cut:
                    held.append(rb.slice(0, cut))
                if cut < len(anchors):
                    yield construct(held)
                    held, count, rb, anchors = [], 0, rb.slice(cut), anchors[cut:]
                else:
                    count += cut
                    continue
            while len(anchors) > BATCH:
                cut = int(np.searchsorted(anchors, anchors[BATCH - 1], "right"))
                if cut == len(anchors):
                    break
                held.append(rb.slice(0, cut))
                yield construct(held)
                held, count, rb, anchors = [], 0, rb.slice(cut), anchors[cut:]
            held.append(rb)
            count += rb.num_rows
        if held:
            yield construct(held)

    return arrow_map(strings, run, "doc_id long, tk long, lo long, hi long")


def _windows(strings: DataFrame, width: int) -> DataFrame:
    """Every window of the strings: ``(doc_id, tk, lo, w1, w2, n)``."""

    def run(batches):
        for rows, data, offs in text_steps(batches, "body", 1 << 18):
            step = min(8, width)
            count = np.diff(offs) - width + 1
            at = ragged(offs[:-1], count)
            who = np.repeat(np.arange(len(count)), count)
            take = pa.array(who)
            col = lambda name: rows.column(rows.schema.get_field_index(name)).take(take)
            yield pa.record_batch({
                "doc_id": col("doc_id"), "tk": col("tk"),
                "lo": pa.array(col("start").to_numpy() + at - offs[who]), "n": col("n"),
                **{name: pa.array(_span(_prefix(data, step, half), at, at + width, step, half).view(np.int64)) for half, name in enumerate(("w1", "w2"))}})

    return arrow_map(strings, run, "doc_id long, tk long, lo long, n long, w1 long, w2 long")


def repeated_spans(docs: DataFrame, scratch: Scratch, width: int = 400, most: int = MOST) -> DataFrame:
    """``(doc_id, tk, lo, hi)``: byte spans (they may overlap) that together
    cover what ``width``-byte repeats cover; ``docs`` has ``doc_id, tk, text``
    where ``tk`` is a hash of the text. The result reads tables of ``scratch``."""
    key = ["anchor", "g1", "g2"]
    first = Scratch()
    occ = first.written(_occurrences(docs, width), "pieces")
    again = first.written(occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "anchors")
    occ = scratch.written(occ.join(again, "anchor"), "repeated")
    first.discard()
    strings = scratch.written(occ.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "tk", "start", "len", "off")).alias("at"))
                      .select(*key, "n", "at.*"), "strings")
    whole = (occ.join(strings.where("n > 1").select(*key), key)
             .select("doc_id", "tk", F.col("start").alias("lo"), (F.col("start") + F.col("len")).alias("hi")))

    # anchors with several strings, one of them at least not yet known to be repeated
    kinds = scratch.written(strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
                    .where("kinds > 1 AND least = 1").select("anchor", "kinds"), "anchors")
    wanted = strings.join(kinds, "anchor")
    per_doc = wanted.groupBy("doc_id", "tk").agg(F.collect_list(F.struct(*key, "n", "start", "len", "off", "kinds")).alias("want"))
    texts = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["doc_id"]) & (docs["tk"] == per_doc["tk"])).select(docs["doc_id"], docs["tk"], "text", "want")

    def bodies(batches):
        for rows, data, offs in text_steps(batches, "text", STEP):
            want = rows.column(rows.schema.get_field_index("want"))
            items = want.flatten()
            who = np.repeat(np.arange(rows.num_rows), want.value_lengths().to_numpy())
            start = items.field("start").to_numpy()
            n = items.field("len").to_numpy().astype(np.int64)
            body = data[ragged(offs[who] + start, n)]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            take = pa.array(who)
            yield pa.record_batch({
                "doc_id": rows.column(0).take(take), "tk": rows.column(1).take(take), "anchor": items.field("anchor"),
                "n": items.field("n"), "start": items.field("start"), "off": items.field("off"), "kinds": items.field("kinds"),
                "body": pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(body)])})

    strings = arrow_map(texts, bodies, "doc_id long, tk long, anchor long, n long, start long, off int, kinds long, body binary")
    if kinds.where(F.col("kinds") > most).isEmpty():
        mine, hot = strings, None
    else:
        strings = scratch.written(strings, "bodies")
        mine, hot = strings.where(F.col("kinds") <= most), strings.where(F.col("kinds") > most)
    mine = mine.drop("kinds").repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
    spans = whole.unionByName(_compared(mine, width))
    if hot is not None:
        windows = scratch.written(_windows(hot, width), "windows")
        twice = scratch.written(windows.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where("n > 1").select("w1", "w2"), "windows")
        spans = spans.unionByName(windows.where("n = 1").join(twice, ["w1", "w2"])
                                  .select("doc_id", "tk", "lo", (F.col("lo") + width).alias("hi")))
    return spans


def _keyed(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    return df.select(c(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"),
                     F.struct(F.lit(0).alias("_"), *[c(x) for x in carry]).alias("carry"))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of a union of spans (touching ones join)."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[head], hi[np.concatenate([head[1:] - 1, [len(hi) - 1]])]


def remaining(texts: list[np.ndarray], los: pa.Array, his: pa.Array) -> tuple[list[bytes], list[list[dict]]]:
    """What remains of each text without its spans, and the spans, merged."""
    kept, spans = [], []
    for i, text in enumerate(texts):
        if not los[i].is_valid:
            kept.append(text.tobytes())
            spans.append([])
            continue
        lo, hi = merged(los[i].values.to_numpy(), his[i].values.to_numpy())
        cuts = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(text)]])
        kept.append(b"".join(text[a:b].tobytes() for a, b in zip(cuts[0::2], cuts[1::2])))
        spans.append([{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)])
    return kept, spans


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400,
                     most: int = MOST, carry: tuple[str, ...] = (), as_text: bool = False, also: int | None = None) -> DataFrame:
    """``(id, n_bytes, spans, kept)``, one row per input row, and the columns
    named in ``carry``: the removed maximal byte spans
    ``array<struct<lo, hi>>`` and the remaining bytes. These are binary, as a
    cut may split a UTF-8 character; with ``as_text`` they are a string
    without the rest of split characters. With ``also``, a second width, a
    column ``kept_<also>`` holds what remains of the text as it came in when
    repeats of that width go.

    * texts are UTF-8 bytes, null counts as empty; matches never cross texts;
    * a text shorter than ``width`` bytes loses nothing;
    * rows are documents of their own: repeated rows repeat each other, and
      rows under one id with different texts are judged separately;
    * null ids are kept; other columns (whatever their names) are ignored;
      an empty table gives an empty result. Ids are integers.
    """
    docs = _keyed(df, id_col, text_col, carry)
    widths = [width] if also is None else [width, also]
    found = []
    for i, w in enumerate(widths):
        scratch = Scratch()
        found.append(written(repeated_spans(docs.drop("carry"), scratch, w, most), "spans").withColumn("of", F.lit(i)))
        scratch.discard()
    lists = [F.collect_list(F.when(F.col("of") == i, F.col(x))).alias(f"{x}{i}") for i in range(len(widths)) for x in ("lo", "hi")]
    per_doc = reduce(DataFrame.unionByName, found).groupBy("doc_id", "tk").agg(*lists)
    both = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["doc_id"]) & (docs["tk"] == per_doc["tk"]), "left")
    both = both.select(docs["doc_id"], "text", "carry", *per_doc.columns[2:])
    kinds = T.StringType() if as_text else T.BinaryType()
    names = ["kept"] + [f"kept_{w}" for w in widths[1:]]
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType())]))),
        *[T.StructField(x, kinds) for x in names], both.schema["carry"]])

    def run(batches):
        for rows, data, offs in text_steps(batches, "text", 2 * STEP):
            texts = [data[a:b] for a, b in zip(offs, offs[1:])]
            cols = [remaining(texts, rows.column(3 + 2 * i), rows.column(4 + 2 * i)) for i in range(len(widths))]
            yield pa.record_batch({"doc_id": rows.column(0), "n_bytes": pa.array(np.diff(offs)),
                                   "spans": pa.array(cols[0][1], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                                   **{x: pa.array([whole_characters(b) for b in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                                      for x, (kept, _) in zip(names, cols)},
                                   "carry": rows.column(2)})

    out = arrow_map(both, run, schema)
    return out.select(F.col("doc_id").alias(id_col), "n_bytes", "spans", *names, *[F.col("carry").getField(x).alias(x) for x in carry])


def whole_characters(kept: bytes) -> str:
    """Remaining bytes as text; bytes of a character that a cut has split go."""
    return kept.decode("utf-8", "ignore")


def digest(result: DataFrame, id_col: str = "doc_id", text: bool = False, also: int | None = None) -> DataFrame:
    """Counts and digest of ``dedup_substrings``' output; with ``text`` also the remaining text (a split
    character shows as U+FFFD), with ``also`` the one of that second width."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["hi"] - s["lo"])
    shown = ([("kept", "text")] if text else []) + ([(f"kept_{also}", f"text_{also}")] if also else [])
    rest = [F.make_valid_utf8(F.col(kept).cast("string")).alias(name) for kept, name in shown]
    return result.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                         F.sha2("kept", 256).alias("kept_sha256"), *rest)
