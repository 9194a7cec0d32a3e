"""Line deduplication with a log-template tree.

A line's path in the tree has fixed depth: its token count, then its leading
tokens; tokens with a digit are variable fields and read ``<*>``. The lines of
a leaf are clustered into templates: the most frequent line leads, lines that
agree with it in enough positions join, and positions in which they differ
become ``<*>``. Lines whose template recurs in many documents are dropped,
except in the first of these documents.

Equal lines are counted before they are clustered, leaves that cannot reach
the number of documents never leave the counting step, and only one text per
distinct line is fetched. A large leaf is clustered in rounds, which give the
clusters of one pass over it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import Scratch, arrow_map, byte_view, c, mix64, partitions, ragged, span_hashes, text_steps, written

STAR = "<*>"
LEAD = 4           # leading tokens of the path
MIN_TOKENS = 3     # shorter lines are never dropped
MIN_DOCS = 10      # documents in which a template recurs
SIMILAR = 0.7      # share of equal positions
#: Tokens of one clustering step; a leaf with more is clustered in rounds of about so many.
CELLS = 1 << 22
STEP = 1 << 19
#: Place of a line that is no leader.
NO_PLACE = 1 << 62
LEADERS = ["leaf", "line", "leader", "template"]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0"):ord("9") + 1] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_HAS_DIGIT = re.compile(rb"[0-9]")


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each token of the texts; tokens are separated by
    ASCII white space, and all that have a digit are one variable token."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    first, final = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
    first[edge] = inside[1:-1][edge]
    final[edge - 1] = inside[1:-1][edge - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(final) + 1
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    return np.where(digits[b] > digits[a], np.uint64(0x2545F4914F6CDD1D), span_hashes(data, a, b)), a


def parse_lines(data: np.ndarray, offs: np.ndarray, lead: int):
    """Lines of the texts: ``(text, start, end, tokens, leaf hash, line hash)``.
    Lines end at ``\\n``."""
    newline = np.flatnonzero(data == 10)
    # a text's start, and behind each newline; a newline that ends a text opens an empty last line there
    place = np.concatenate([offs[:-1], newline + 1])
    owner = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs[1:], newline, "right")])
    order = np.lexsort((owner, place))
    starts, text = place[order], owner[order]
    last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
    ends = np.where(last, offs[text + 1], np.concatenate([starts[1:], [0]]) - 1) if len(text) else starts
    token, a = token_hashes(data, offs)
    at = np.searchsorted(a, starts)
    stop = np.searchsorted(a, ends)
    count = stop - at
    whole = span_hashes(token, at, stop)
    leaf = mix64(span_hashes(token, at, np.minimum(at + lead, stop)) ^ (count.astype(np.uint64) << np.uint64(40)))
    return text, starts, ends, count, leaf, whole


def tokens_of(line: bytes) -> list[bytes]:
    return [STAR.encode() if _HAS_DIGIT.search(w) else w for w in _WORD.findall(line)]


def cluster(lines: list[bytes], similar: float) -> tuple[np.ndarray, dict[int, bytes]]:
    """Leader of each line (lines have equal token counts and come most
    frequent first), and the template of each leader's cluster. Tokens are
    compared by hash, in one array of 8 bytes a token."""
    token, _ = token_hashes(np.frombuffer(b"".join(lines), np.uint8), np.cumsum([0] + [len(x) for x in lines]))
    grid = token.reshape(len(lines), -1)
    leader = np.full(len(lines), -1, np.int64)
    todo = np.arange(len(lines))
    templates = {}
    need = similar * grid.shape[1]
    while len(todo):
        same = grid[todo] == grid[todo[0]]
        join = same.sum(axis=1) >= need
        join[0] = True
        leader[todo[join]] = todo[0]
        fixed = same[join].all(axis=0)
        templates[int(todo[0])] = b" ".join(w if f else STAR.encode() for w, f in zip(tokens_of(lines[todo[0]]), fixed))
        todo = todo[~join]
    return leader, templates


def _rows(docs: DataFrame, lead: int, min_tokens: int) -> DataFrame:
    def run(batches):
        for part, data, offs in text_steps(batches, "text", STEP):
            text, start, end, count, leaf, line = parse_lines(data, offs, lead)
            number = np.arange(len(text)) - np.searchsorted(text, text)
            keep = np.flatnonzero(count >= min_tokens)
            take = pa.array(text[keep])
            yield pa.record_batch({
                "doc_id": part.column(0).take(take), "tk": part.column(1).take(take), "number": pa.array(number[keep]),
                "start": pa.array(start[keep] - offs[text[keep]]), "len": pa.array(end[keep] - start[keep]),
                "tokens": pa.array(count[keep]), "leaf": pa.array(leaf[keep].view(np.int64)), "line": pa.array(line[keep].view(np.int64))})

    return arrow_map(docs, run, "doc_id long, tk long, number long, start long, len long, tokens long, leaf long, line long")


def _bodies(several: DataFrame, docs: DataFrame) -> DataFrame:
    """``several`` as ``(leaf, line, n, tokens, large, body)``, with the bytes of each distinct line."""
    per_doc = several.groupBy("doc_id", "tk").agg(
        F.collect_list(F.struct("leaf", "line", "n", "tokens", "large", "start", "len")).alias("want"))
    texts = (docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["doc_id"]) & (docs["tk"] == per_doc["tk"]))
             .select("text", "want"))

    def fetch(batches):
        for part, data, offs in text_steps(batches, "text", STEP):
            want = part.column(1)
            items, who = want.flatten(), np.repeat(np.arange(part.num_rows), want.value_lengths().to_numpy())
            size = items.field("len").to_numpy()
            body = data[ragged(offs[who] + items.field("start").to_numpy(), size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.record_batch({**{k: items.field(k) for k in ("leaf", "line", "n", "tokens", "large")},
                                   "body": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(body)])})

    bodies = arrow_map(texts, fetch, "leaf long, line long, n long, tokens long, large boolean, body binary")
    # repeated rows fetch a line once each: keep one
    return bodies.groupBy("leaf", "line").agg(*[F.max(k).alias(k) for k in ("n", "tokens", "large")], F.first("body").alias("body"))


def _clustered(bodies: DataFrame, similar: float) -> DataFrame:
    """``(leaf, line, leader, place, tokens, template, body)``: the clusters of
    leaves that one task can hold. The last three are given in the leader's
    own row only; ``place`` orders a leaf's leaders."""
    bodies = (bodies.select("leaf", "line", "n", "tokens", "body").repartition(partitions(bodies.sparkSession), "leaf")
              .sortWithinPartitions("leaf", F.desc("n"), "line"))

    def run(batches):
        held: list[tuple] = []

        def done():
            leader, text = cluster([r[4] for r in held], similar)
            leader = leader.tolist()
            own = [k if k == x else None for k, x in enumerate(leader)]
            return pa.record_batch({
                "leaf": pa.array([r[0] for r in held], pa.int64()), "line": pa.array([r[1] for r in held], pa.int64()),
                "leader": pa.array([held[k][1] for k in leader], pa.int64()), "place": pa.array(leader, pa.int64()),
                "tokens": pa.array([r[3] for r in held], pa.int64()),
                "template": pa.array([None if k is None else text[k] for k in own], pa.binary()),
                "body": pa.array([None if k is None else held[k][4] for k in own], pa.binary())})

        for rb in batches:
            for row in zip(*(rb.column(k).to_pylist() for k in ("leaf", "line", "n", "tokens", "body"))):
                if held and held[-1][0] != row[0]:
                    yield done()
                    held.clear()
                held.append(row)
        if held:
            yield done()

    return arrow_map(bodies, run, "leaf long, line long, leader long, place long, tokens long, template binary, body binary")


def _joined(rows: DataFrame, similar: float) -> DataFrame:
    """Lines join the first leader that they agree with. ``rows`` hold the
    leaders (with a ``place``) before the lines of each ``(leaf, salt)``. Lines
    that join none keep their body and have no leader; rows without a line
    hold the template of a leader with the lines that joined here."""

    def run(batches):
        key, heads, grid, fixed, hit = None, [], None, None, None

        def templates():
            out = [(h, f) for h, f, x in zip(heads, fixed, hit) if x] if grid is not None else []
            if out:
                none = lambda kind: pa.nulls(len(out), kind)
                yield pa.record_batch({
                    "leaf": pa.array([key[0]] * len(out), pa.int64()), "line": none(pa.int64()), "n": none(pa.int64()), "tokens": none(pa.int64()),
                    "body": none(pa.binary()), "leader": pa.array([h[0] for h, _ in out], pa.int64()),
                    "template": pa.array([b" ".join(w if f else STAR.encode() for w, f in zip(tokens_of(h[1]), fix)) for h, fix in out], pa.binary())})

        for rb in batches:
            leaf, salt = rb.column("leaf").to_numpy(), rb.column("salt").to_numpy()
            turn = np.flatnonzero((leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1])) + 1
            for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(leaf)]):
                if a == b:
                    continue
                if key != (leaf[a], salt[a]):
                    yield from templates()
                    key, heads, grid = (leaf[a], salt[a]), [], None
                part = rb.slice(a, b - a)
                lead = int((part.column("place").to_numpy() < NO_PLACE).sum())
                heads += zip(part.column("line")[:lead].to_pylist(), part.column("body")[:lead].to_pylist())
                part = part.slice(lead)
                if not part.num_rows:
                    continue
                if grid is None:
                    grid = token_hashes(np.frombuffer(b"".join(x for _, x in heads), np.uint8),
                                        np.cumsum([0] + [len(x) for _, x in heads]))[0].reshape(len(heads), -1)
                    fixed, hit = np.ones(grid.shape, bool), np.zeros(len(heads), bool)
                data, offs = byte_view(part.column("body"))
                token = token_hashes(data[offs[0]:offs[-1]], offs - offs[0])[0].reshape(part.num_rows, -1)
                found, todo = np.full(len(token), -1, np.int64), np.arange(len(token))
                for h in range(len(heads)):
                    same = token[todo] == grid[h]
                    join = same.sum(axis=1) >= similar * grid.shape[1]
                    if join.any():
                        fixed[h] &= same[join].all(axis=0)
                        hit[h] = True
                        found[todo[join]] = h
                        todo = todo[~join]
                        if not len(todo):
                            break
                lost = pa.array(np.arange(len(found)), mask=found >= 0)
                yield pa.record_batch({
                    **{k: part.column(k) for k in ("leaf", "line", "n", "tokens")},
                    "body": part.column("body").take(lost),
                    "leader": pa.array([None if h < 0 else heads[h][0] for h in found.tolist()], pa.int64()),
                    "template": pa.nulls(part.num_rows, pa.binary())})
        yield from templates()

    rows = (rows.select("leaf", "salt", "place", "line", "n", "tokens", "body")
            .repartition(partitions(rows.sparkSession), "leaf", "salt").sortWithinPartitions("leaf", "salt", "place"))
    return arrow_map(rows, run, "leaf long, line long, n long, tokens long, body binary, leader long, template binary")


def _large_leaders(rest: DataFrame, scratch: Scratch, similar: float) -> DataFrame:
    """``_leaders`` of leaves that are too large for one task. A round clusters
    the first lines of what is left of a leaf, about ``CELLS`` tokens, in one
    task; the later lines, dealt over many, join the first of the round's
    leaders that they agree with, or are left for the next round. A line so
    gets the leader of one pass over the whole leaf, whatever ``CELLS`` is."""
    done, before = [], Scratch()
    while True:
        now = Scratch()
        # the lines' order is (most frequent, line hash); rounds take whole slots of it
        slot = F.struct((-F.col("n")).alias("m"), F.shiftright("line", 52).alias("slot"))
        sums = rest.groupBy("leaf", slot.alias("slot")).agg(F.sum("tokens").alias("cells"))
        sums = sums.withColumn("ahead", F.sum("cells").over(Window.partitionBy("leaf").orderBy("slot")) - F.col("cells"))
        ends = now.written(sums.groupBy("leaf").agg(F.max(F.when(F.col("ahead") < CELLS, F.col("slot"))).alias("last"),
                                                    F.ceil(F.sum("cells") / CELLS).alias("parts")), "ends")
        if ends.isEmpty():
            break
        placed = rest.join(ends, "leaf")
        first = now.written(_clustered(placed.where(slot <= F.col("last")), similar), "first")
        heads = (first.where("line = leader").join(ends, "leaf")
                 .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("n", F.lit(0).cast("long")))
        later = (placed.where(slot > F.col("last")).withColumn("salt", F.pmod("line", "parts"))
                 .withColumn("place", F.lit(NO_PLACE)))
        columns = ["leaf", "salt", "place", "line", "n", "tokens", "body"]
        got = now.written(_joined(heads.select(*columns).unionByName(later.select(*columns)), similar), "joined")
        done.append(scratch.written(first.select(*LEADERS).unionByName(got.where("leader IS NOT NULL").select(*LEADERS)), "leaders"))
        rest = got.where("leader IS NULL").drop("leader", "template")
        before.discard()
        before = now
    before.discard()
    now.discard()
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _leaders(several: DataFrame, docs: DataFrame, scratch: Scratch, similar: float) -> DataFrame:
    """``(leaf, line, leader, template)`` of the distinct lines of leaves that
    hold several. A template is given in some of its leader's rows, which may
    have no line, and each may leave places fixed that another has not."""
    bodies = _bodies(several, docs)
    if several.where("large").isEmpty():
        return _clustered(bodies, similar).select(*LEADERS)
    bodies = scratch.written(bodies, "bodies")
    return (_clustered(bodies.where("NOT large"), similar).select(*LEADERS)
            .unionByName(_large_leaders(bodies.where("large").drop("large"), scratch, similar)))


def _templates(leaders: DataFrame) -> DataFrame:
    """``(leaf, leader, template)``: a place is fixed if it is in all rows of the leader."""
    words = lambda x: F.split(x.cast("string"), " ", -1)
    both = lambda x, y: F.zip_with(x, words(y), lambda v, w: F.when(v == w, v).otherwise(F.lit(STAR)))
    some = leaders.where("template IS NOT NULL").groupBy("leaf", "leader").agg(F.collect_set("template").alias("some"))
    return some.select("leaf", "leader", F.concat_ws(" ", F.aggregate("some", words(F.col("some")[0]), both)).cast("binary").alias("template"))


def find_templates(docs: DataFrame, scratch: Scratch, lead: int = LEAD, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS,
                   similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """``(lines to drop: doc_id, tk, number; templates: leaf, leader,
    documents, template)`` of documents with ``doc_id, tk, text``. Both read
    tables of ``scratch``."""
    rows = scratch.written(_rows(docs, lead, min_tokens), "lines")
    leaves = scratch.written(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("leaf"), "leaves")
    rows = scratch.written(rows.join(leaves, "leaf"), "lines")
    distinct = scratch.written(rows.groupBy("leaf", "line").agg(
        F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"), F.min(F.struct("doc_id", "tk", "start", "len")).alias("at"))
        .select("leaf", "line", "n", "tokens", "at.*"), "distinct")
    kinds = scratch.written(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("tokens").alias("cells")).where("kinds > 1"), "leaves")
    several = distinct.join(kinds.select("leaf", (F.col("cells") > CELLS).alias("large")), "leaf")
    leaders = scratch.written(_leaders(several, docs, scratch, similar), "leaders")
    rows = (rows.join(leaders.where("line IS NOT NULL").select("leaf", "line", "leader"), ["leaf", "line"], "left")
            .select("doc_id", "tk", "number", "leaf", F.coalesce("leader", "line").alias("leader")))
    spread = (rows.groupBy("leaf", "leader", "doc_id", "tk").agg(F.lit(1).alias("one"))
              .groupBy("leaf", "leader").agg(F.count(F.lit(1)).alias("documents"),
                                             F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "tk")).alias("home")))
    spread = spread.where(F.col("documents") >= min_docs).join(_templates(leaders), ["leaf", "leader"], "left")
    spread = scratch.written(spread.select("leaf", "leader", "documents", "template", "home"), "templates")
    hits = rows.join(spread.select("leaf", "leader", "home"), ["leaf", "leader"])
    drop = hits.where(~(F.col("doc_id").eqNullSafe(F.col("home.doc_id")) & (F.col("tk") == F.col("home.tk"))))
    return drop.select("doc_id", "tk", "number"), spread.drop("home")


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = LEAD,
               min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS, similar: float = SIMILAR,
               carry: tuple[str, ...] = ()) -> DataFrame:
    """``df``'s rows as ``(id, n_lines, n_dropped, text)`` and the columns
    named in ``carry``; ``text`` holds the remaining lines.

    * a null text has one empty line and becomes empty; an empty text stays;
    * lines of fewer than ``min_tokens`` tokens are never dropped;
    * a template counts the documents in which it occurs (repeated rows of one
      id and text are one document) and stays in the first: the smallest id,
      null ids last;
    * a leaf of more than ``CELLS`` tokens is clustered in rounds, with the
      same clusters as in one;
    * other columns (whatever their names) are ignored; an empty table gives
      an empty result. Ids are integers.
    """
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    docs = df.select(c(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tk"), text.alias("text"),
                     F.struct(F.lit(0).alias("_"), *[c(x) for x in carry]).alias("carry"))
    scratch = Scratch()
    drop, _ = find_templates(docs.drop("carry"), scratch, lead, min_tokens, min_docs, similar)
    drop = written(drop, "drop")
    scratch.discard()
    per_doc = drop.distinct().groupBy("doc_id", "tk").agg(F.collect_list("number").alias("gone"))
    both = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc["doc_id"]) & (docs["tk"] == per_doc["tk"]), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i.cast("long"))), "\n"))
    return both.select(docs["doc_id"].alias(id_col), F.size(lines).cast("long").alias("n_lines"),
                       F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text"),
                       *[F.col("carry").getField(x).alias(x) for x in carry])
