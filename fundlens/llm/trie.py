"""Conversation prefix trie: depth-band rollup.

A node of the trie is a distinct sequence of first turns. Nothing here walks a
conversation turn by turn, and no step's size depends on the deepest one:

* **Positions.** Turns are range-sorted by (conversation, turn) over all
  partitions; the counts of a conversation in earlier partitions give the
  position of each turn, so a conversation of any length is many tasks' work.
* **Node names.** Depths fall into bands of ``height``. Inside a band a turn's
  prefix digest covers the band's turns up to it; the digests of full bands are
  the turns of a sequence one level up, named by the same rule. So a depth of D
  takes log(D) / log(height) levels, and each window holds ``height`` rows.
* **Rollup.** A node explodes only to its ancestors inside its band. The sums
  below the band roots are rolled up on the tree of band roots in the same way
  (one level up), and the completed totals of band roots then enter the band
  above through its lowest nodes. Explosion is at most ``height`` rows a node,
  rounds are the levels.

Names are SHA-256 digests over digests of (role, text); texts themselves are
read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlens.llm.common import Scratch, arrow_map, c, partitions, written

#: Depths of a band.
HEIGHT = 16
#: Name of the root: the digest of no turn.
ROOT = hashlib.sha256(b"").digest()
#: Conversation ids that one row of joined ids holds.
IDS_PER_ROW = 4096


def _digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turn_digests(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``(conv, turn, t, size)``: digest of (role, text) and UTF-8 bytes of the text; null role or text is empty."""
    role = F.coalesce(c(role_col).cast("string"), F.lit(""))
    text = F.coalesce(c(text_col).cast("string"), F.lit(""))
    head = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)      # the length keeps role and text apart
    return df.where(c(conv_col).isNotNull()).select(
        c(conv_col).cast("long").alias("conv"), c(turn_col).alias("turn"),
        F.unhex(F.sha2(head.cast("binary"), 256)).alias("t"), F.octet_length(text).cast("long").alias("size"))


def ordered(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(conv, part, at, t, size)`` in order, written, and the runs ``(conv, part, first, n, before)``:
    a turn's position in its conversation is ``before + at - first + 1``. Equal turns go by their digest."""
    order = ["conv", F.asc_nulls_first("turn"), "t", "tie"]
    ranged = (turns.withColumn("tie", F.monotonically_increasing_id())                # spreads repeated rows
              .repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order))
    rows = scratch.written(ranged.select("conv", F.spark_partition_id().alias("part"),
                                         F.monotonically_increasing_id().alias("at"), "t", "size"), "trie-turns")
    runs = rows.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, scratch.written(runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "trie-runs")


def rebuilt(rows: DataFrame, runs: DataFrame, spread: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """``(conv, depth, t, size, length)`` of the rebuilt conversations, and ``(conv, length)`` of all of them.

    Conversation ``c`` is the first ``h = crc32(c) % most`` turns of
    ``c - c % spread``, then its own turns after its first ``h``."""
    lengths = runs.groupBy("conv").agg(F.sum("n").alias("n"))
    head = lambda conv: F.crc32(conv.cast("string").cast("binary")) % most
    base = lambda conv: conv - conv % spread
    other = lengths.select(F.col("conv").alias("_base"), F.col("n").alias("_n"))
    # the head that a conversation borrows: its own when it is its own base
    info = (lengths.withColumns({"_base": base(F.col("conv")), "h": head(F.col("conv"))}).join(other, "_base", "left")
            .withColumn("borrowed", F.least("h", F.coalesce("_n", F.lit(0))))
            .withColumn("length", F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    lens = info.select("conv", "length")
    # runs, not conversations, are joined to the turns: a long conversation has a run in each of its partitions
    shift = runs.join(info.select("conv", "h", "borrowed", "length"), "conv").select(
        "conv", "part", (F.col("before") - F.col("first") + 1).alias("shift"), "h", "borrowed", "length")
    placed = rows.join(shift, ["conv", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    own = placed.where(F.col("pos") > F.col("h")).select(
        "conv", (F.col("borrowed") + F.col("pos") - F.col("h")).alias("depth"), "t", "size", "length")
    near = F.filter(F.sequence(F.col("conv") - (spread - 1), F.col("conv") + (spread - 1)),
                    lambda x: (base(x) == F.col("conv")) & (F.col("pos") <= head(x)))
    lent = (placed.where((F.col("pos") < most) & (F.col("conv") % spread == 0))
            .select(F.explode(near).alias("conv"), F.col("pos").alias("depth"), "t", "size")
            .join(lens, "conv"))
    return own.unionByName(lent), lens


def named(rows: DataFrame, deepest: int, height: int, scratch: Scratch) -> list[DataFrame]:
    """Per level ``(conv, i, name, path)`` of the sequences ``(conv, i, t)``, ``i`` from 1; ``path`` holds the
    names of the band's nodes from the band root to the node itself. Level 0 is of the rows, level 1 of their full
    bands, and so on. Other columns are kept at level 0."""
    band = F.floor((F.col("i") - 1) / height).cast("long")
    inside = Window.partitionBy("conv", "band").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    local = (rows.withColumn("band", band)
             .withColumn("name", F.unhex(F.sha2(F.array_join(F.transform(F.collect_list("t").over(inside), F.hex), "").cast("binary"), 256))))
    above: list[DataFrame] = []
    if deepest > height:
        local = scratch.written(local, "trie-band")
        full = local.where(F.col("i") % height == 0).select("conv", (F.col("i") / height).cast("long").alias("i"),
                                                            F.col("name").alias("t"))
        above = named(full, deepest // height, height, scratch)
        ends = above[0].select("conv", "i", "name")
        # the name of a band's root, and of its lowest node where the band is full
        roots = ends.select("conv", F.col("i").alias("band"), F.col("name").alias("_root"), F.lit(None).cast("binary").alias("_last"))
        lasts = ends.select("conv", (F.col("i") - 1).alias("band"), F.lit(None).cast("binary").alias("_root"), F.col("name").alias("_last"))
        both = roots.unionByName(lasts).groupBy("conv", "band").agg(F.max("_root").alias("_root"), F.max("_last").alias("_last"))
        local = (local.join(both, ["conv", "band"], "left").withColumn(
            "name", F.when(F.col("i") % height == 0, F.col("_last")).when(F.col("_root").isNull(), F.col("name"))
            .otherwise(_digest(F.col("_root"), F.col("name")))).withColumn("_root", F.coalesce("_root", F.lit(ROOT))).drop("_last"))
    else:
        local = local.withColumn("_root", F.lit(ROOT))
    out = local.withColumn("path", F.concat(F.array("_root"), F.collect_list("name").over(inside))).drop("t", "band", "_root")
    return [scratch.written(out, "trie-named"), *above]


def band_rollup(nodes: list[DataFrame], values: Sequence[str], height: int, scratch: Scratch, level: int = 0) -> DataFrame:
    """``(name, *values)``: subtree sums of ``values`` at every node below the root and at the root.

    ``nodes[level]`` is ``(name, i, path, *values)``, the root not among them; ``nodes[level + 1:]`` are the
    band roots of the levels above, without values. The values of the root itself count as 0."""
    here = nodes[level]
    to_root = here.groupBy(F.col("path")[0].alias("name")).agg(*[F.sum(v).alias(v) for v in values])
    if level + 1 == len(nodes):
        done = to_root.where(F.col("name") == F.lit(ROOT))
        enter = here
    else:
        below = scratch.written(to_root, "trie-below")
        up = nodes[level + 1].join(below, "name", "left").na.fill(0, list(values))
        root = below.where(F.col("name") == F.lit(ROOT))
        above = scratch.written(band_rollup([*nodes[:level + 1], up, *nodes[level + 2:]], values, height, scratch, level + 1), "trie-above")
        # of the tree of band roots, the root's sum lacks what lies in the root's own band
        done = root.unionByName(above.where(F.col("name") == F.lit(ROOT))).groupBy("name").agg(*[F.sum(v).alias(v) for v in values])
        totals = above.select("name", *[F.col(v).alias(f"_{v}") for v in values])
        low = here.where(F.col("i") % height == 0).join(totals, "name", "left")
        low = low.select("path", *[(F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values])
        enter = here.where(F.col("i") % height != 0).select("path", *values).unionByName(low)
    inside = enter.select(F.explode(F.slice("path", 2, height)).alias("name"), *values)
    return inside.groupBy("name").agg(*[F.sum(v).alias(v) for v in values]).unionByName(done)


def id_digests(members: DataFrame) -> DataFrame:
    """``(name, ends_sha256)`` of ``(name, conv)``: SHA-256 of each name's ids, ascending and comma-joined.

    Ids are joined in range-sorted order, many tasks a name; a digest then reads few rows of joined ids as a stream."""
    n = partitions(members.sparkSession)
    ranged = members.repartitionByRange(n, "name", "conv").sortWithinPartitions("name", "conv")

    def join(batches):
        for rb in batches:
            names, ids = rb.column(0), rb.column(1).to_numpy()
            text = list(map(str, ids.tolist()))
            cuts = [0] + [k for k, (a, b) in enumerate(zip(names[:-1].to_pylist(), names[1:].to_pylist()), 1) if a != b] + [len(ids)]
            spans = [(s, min(s + IDS_PER_ROW, e)) for a, e in zip(cuts, cuts[1:]) for s in range(a, e, IDS_PER_ROW)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array([s for s, _ in spans], pa.int64())), pa.array([int(ids[s]) for s, _ in spans], pa.int64()),
                                              pa.array([",".join(text[s:e]) for s, e in spans], pa.string())], names=["name", "least", "ids"])

    joined = arrow_map(ranged.select("name", "conv"), join, "name binary, least long, ids string")
    streams = joined.repartition(n, "name").sortWithinPartitions("name", "least").select("name", "ids")

    def digest(batches):
        now, state = None, None
        for rb in batches:
            out = []
            for name, ids in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                if name == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = name, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends_sha256"])

    return arrow_map(streams, digest, "name binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, lengths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of sequences ``(conv, depth, t, size, length)`` (depth from 1, gapless; ``t`` names a turn) with
    ``(conv, length)`` of all sequences, empty ones included: one row per node, as ``conversation_trie`` returns."""
    if height < 2:
        raise ValueError("a band holds two depths or more")
    scratch = Scratch()
    rows = scratch.written(rows.withColumnRenamed("depth", "i"), "trie-rebuilt")
    lengths = scratch.written(lengths, "trie-lengths")
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("deepest")).first()
    levels = named(rows, total["deepest"] or 0, height, scratch)
    ends = F.col("length") == F.col("i")
    nodes = levels[0].groupBy("name").agg(
        F.min("conv").alias("conv_id"), F.min("i").alias("i"), F.count(F.lit(1)).alias("n_convs"), F.count_if(~ends).alias("_on"),
        F.min("size").alias("size"), F.first("path").alias("path"))
    nodes = scratch.written(nodes.select("name", "conv_id", "i", "n_convs", "path", F.when(F.col("_on") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                         ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), "trie-nodes")
    values = ["n_leaves", "saved_tokens"]
    uppers = [lv.groupBy("name").agg(F.min("i").alias("i"), F.first("path").alias("path")) for lv in levels[1:]]
    sums = band_rollup([nodes.select("name", "i", "path", *values), *uppers], values, height, scratch)
    parent = F.element_at("path", -2)
    children = nodes.groupBy(parent.alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    last = levels[0].where(ends).select("name", "conv").unionByName(
        lengths.where("length = 0").select(F.lit(ROOT).alias("name"), "conv"))
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    every = nodes.select("name", "conv_id", "i", "n_convs", parent.alias("_parent")).unionByName(
        root.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("i"), "n_convs", F.lit(None).cast("binary").alias("_parent")))
    every = every.join(sums, "name", "left").join(children, "name", "left").join(id_digests(last), "name", "left")
    tops = scratch.written(nodes.select(F.col("name").alias("_parent"), F.col("conv_id").alias("parent_conv_id")).unionByName(
        root.select(F.lit(ROOT).alias("_parent"), F.col("conv_id").alias("parent_conv_id"))), "trie-parents")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    # an empty sequence can only end at the root, which then is the one leaf
    leaves = F.when((F.col("i") == 0) & F.col("n_children").isNull(), 1).otherwise(F.coalesce("n_leaves", F.lit(0))).cast("long")
    out = every.join(tops, "_parent", "left").select(
        "conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", zero("n_children"), leaves.alias("n_leaves"), zero("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    out = written(out, "trie")
    scratch.discard()
    return out


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", height: int = HEIGHT, spread: int = 5, most: int = 9) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, one row per
    node of the prefix trie of the rebuilt conversations (``rebuilt``).

    * turns go by ``turn`` (null first); equal or null turns by the digest of (role, text), so that the order does
      not depend on the partitions;
    * null role or text counts as empty; rows with a null conversation id take no part (they have no id to be rebuilt by);
    * repeated rows are turns of their own; ``%`` keeps the sign of a negative id, as in SQL;
    * conversations that end up without a turn are members of the root;
    * other columns (whatever their names) are ignored; an empty table gives an empty result, without a root.
    """
    scratch = Scratch()
    rows, runs = ordered(turn_digests(df, conv_col, turn_col, role_col, text_col), scratch)
    turns, lengths = rebuilt(rows, runs, spread, most)
    out = prefix_trie(turns, lengths, height)
    scratch.discard()
    return out


#: DuckDB twin of the registered query. CRC-32 is spelt out: eight shifts a byte, polynomial 0xEDB88320.
ORACLE = """
WITH o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (
  SELECT c, max(p) AS n, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
    lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda s, z:
      CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM o GROUP BY c),
i AS (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS borrowed FROM n LEFT JOIN n b ON b.c = n.c - n.c % 5),
r AS (
  SELECT i.c, o.p AS d, o.role, o.text FROM i JOIN o ON o.c = i.c - i.c % 5 AND o.p <= i.h
  UNION ALL
  SELECT i.c, i.borrowed + o.p - i.h, o.role, o.text FROM i JOIN o ON o.c = i.c AND o.p > i.h),
l AS (SELECT i.c, coalesce(max(r.d), 0) AS len, list(sha256(strlen(r.role)::VARCHAR || ':' || r.role || r.text) ORDER BY r.d) FILTER (r.d IS NOT NULL) AS seq,
             list(strlen(r.text) ORDER BY r.d) FILTER (r.d IS NOT NULL) AS sizes
      FROM i LEFT JOIN r ON r.c = i.c GROUP BY i.c),
m AS (
  SELECT c, len, d, CASE WHEN d = 0 THEN '' ELSE sha256(list_aggregate(list_slice(seq, 1, d), 'string_agg', '')) END AS k,
         CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
  FROM (SELECT c, len, seq, sizes, unnest(range(0, len + 1)) AS d FROM l)),
g AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256
  FROM m GROUP BY d, k),
a AS (
  SELECT g.d, g.k, m.d AS ad, m.k AS ak, (g.n_convs - 1) * g.size AS saved,
         NOT EXISTS (SELECT 1 FROM m x WHERE x.c = g.conv_id AND x.d = g.d + 1) AND g.n_convs = (
           SELECT count(*) FROM m y WHERE y.d = g.d AND y.k = g.k AND y.len = g.d) AS leaf
  FROM g JOIN m ON m.c = g.conv_id AND m.d <= g.d),
s AS (
  SELECT ad AS d, ak AS k, sum(leaf::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (d = ad + 1) AS n_children
  FROM a GROUP BY ad, ak),
p AS (SELECT a.d, a.k, q.conv_id AS parent_conv_id FROM a JOIN g q ON q.d = a.ad AND q.k = a.ak WHERE a.ad = a.d - 1)
SELECT g.conv_id, g.d::BIGINT AS depth, p.parent_conv_id, g.n_convs, s.n_children, s.n_leaves, s.saved_tokens, g.ends_sha256
FROM g JOIN s USING (d, k) LEFT JOIN p USING (d, k)
"""
