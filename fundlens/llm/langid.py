"""Language identification by prediction by partial matching.

For every language a variable-order byte context tree is counted: how often
each byte followed each context of 0 to 3 bytes. A symbol seen in its longest
context costs ``-log2(count / (total + distinct))`` bits; otherwise the escape
costs ``-log2(distinct / (total + distinct))`` and the next shorter context is
asked, down to a uniform byte. An unseen context costs nothing. The counts are
frozen after training, so a text's code length is exact: the sum of these
costs over all its bytes. The language with the shortest code wins.

The trees are counted on a bounded sample of labelled texts (``SAMPLE``
documents of a language, each at most ``LONGEST`` bytes). Frozen, the cost of
a byte is a function of the byte and the three before it, so it is computed
once per distinct 4-byte sequence of the sample and looked up in a hash table;
sequences never seen are put together from their shorter parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fundlens.llm.common import arrow_map, c, text_steps

ORDER = 3
#: Labelled documents of a language that the trees are counted on, and their longest size.
SAMPLE = 400
LONGEST = 1 << 16
STEP = 1 << 18

_HASH = np.uint32(2654435761)


def _grams(data: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """The ``n``-byte sequence that ends at each byte, as a number; bytes
    before a text's start count as zero bytes."""
    out = np.zeros(len(data), np.uint32)
    place = np.arange(len(data)) - np.repeat(offs[:-1], np.diff(offs)) if n > 1 else None
    near = [np.flatnonzero(place < k) for k in range(1, n)] if n > 1 else []
    for k in range(n):
        part = np.zeros(len(data), np.uint32)
        part[k:] = data[:len(data) - k]
        if k:
            part[near[k - 1]] = 0
        out |= part << np.uint32(8 * k)
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """``(lang, n, gram, hits)`` for n = 1 .. ORDER + 1."""

    def run(batches):
        for rows, data, offs in text_steps(batches, "text", STEP):
            langs = np.array(rows.column(rows.schema.get_field_index("lang")).to_pylist(), object)
            for lang in sorted(set(langs)):
                pick = np.flatnonzero(langs == lang)
                part = np.concatenate([data[offs[i]:offs[i + 1]] for i in pick])
                part_offs = np.cumsum([0] + [int(offs[i + 1] - offs[i]) for i in pick])
                for n in range(1, ORDER + 2):
                    gram, hits = np.unique(_grams(part, part_offs, n), return_counts=True)
                    yield pa.record_batch({"lang": pa.array([lang] * len(gram), pa.string()),
                                           "n": pa.array(np.full(len(gram), n, np.int32)),
                                           "gram": pa.array(gram.astype(np.int64)), "hits": pa.array(hits.astype(np.int64))})

    counts = arrow_map(texts.select("lang", "text"), run, "lang string, n int, gram long, hits long")
    return counts.groupBy("lang", "n", "gram").agg(F.sum("hits").alias("hits"))


class Model:
    """Frozen context trees of all languages, as cost tables (bits)."""

    def __init__(self, counts: pa.Table):
        lang = np.array(counts["lang"].to_pylist(), object)
        self.langs = sorted(set(lang))
        which = np.array([self.langs.index(x) for x in lang], np.int64)
        n, gram = counts["n"].to_numpy(), counts["gram"].to_numpy()
        hits = counts["hits"].to_numpy().astype(np.float64)
        L = len(self.langs)
        # cost[k], keys[k]: of a symbol behind k bytes; esc[k], ctx[k]: of the escape from a context of k bytes
        self.keys, self.cost, self.ctx, self.esc = [], [], [], []
        for k in range(ORDER + 1):
            m = n == k + 1
            keys = np.unique(gram[m])
            count = np.zeros((len(keys), L))
            count[np.searchsorted(keys, gram[m]), which[m]] = hits[m]
            context = keys >> 8
            ctx = np.unique(context)
            at = np.searchsorted(ctx, context)
            total, distinct = np.zeros((len(ctx), L)), np.zeros((len(ctx), L))
            np.add.at(total, at, count)
            np.add.at(distinct, at, count > 0)
            escape = np.where(total > 0, np.log2(np.maximum(total + distinct, 1)) - np.log2(np.maximum(distinct, 1)), 0.0)
            seen = np.log2(np.maximum(total + distinct, 1))[at] - np.log2(np.maximum(count, 1))
            # the bytes of a gram are stored last byte lowest: its context is gram >> 8 and the shorter
            # gram keeps the last byte and one context byte less, the farthest
            lower = self._below(keys, k)
            cost = np.where(count > 0, seen, escape[at] + lower)
            self.keys.append(keys.astype(np.uint32))
            self.cost.append(cost)
            self.ctx.append(ctx.astype(np.uint32))
            self.esc.append(escape)
        self.keys = [_Table(k, v) for k, v in zip(self.keys, self.cost)]
        self.ctx = [_Table(k, v) for k, v in zip(self.ctx, self.esc)]
        del self.cost, self.esc

    def _below(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Cost of the same symbol behind one context byte less, of grams whose shorter form was counted."""
        if k == 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        short = keys & ((1 << (8 * k)) - 1)
        return self.cost[k - 1][np.searchsorted(self.keys[k - 1], short)]

    def byte_costs(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """``(len(data), languages)`` code lengths in bits."""
        gram = _grams(data, offs, ORDER + 1)
        costs, found = self.keys[ORDER].get(gram)
        todo = np.flatnonzero(~found)
        left = gram[todo]
        add = np.zeros((len(todo), len(self.langs)), np.float32)
        for k in range(ORDER, -1, -1):
            if not len(todo):
                break
            add += self.ctx[k].get(left >> np.uint32(8))[0]
            if k == 0:
                costs[todo] = add + np.float32(8)
                break
            left = left & np.uint32((1 << (8 * k)) - 1)
            value, found = self.keys[k - 1].get(left)
            costs[todo[found]] = add[found] + value[found]
            todo, left, add = todo[~found], left[~found], add[~found]
        return costs


class _Table:
    """Open-addressed hash table from 32-bit keys to rows of float32."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        size = 1 << self.bits
        self.slot_key = np.zeros(size, np.uint32)
        self.used = np.zeros(size, bool)
        self.value = np.zeros((size, values.shape[1]), np.float32)
        at = self._slot(keys)
        pending = np.arange(len(keys))
        self.probes = 0
        while len(pending):
            free = pending[~self.used[at[pending]]]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.used[at[put]], self.slot_key[at[put]], self.value[at[put]] = True, keys[put], values[put]
            pending = np.setdiff1d(pending, put, assume_unique=True)
            at[pending] = (at[pending] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * _HASH) >> np.uint32(32 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and whether the key was there (zeros if not)."""
        at = self._slot(keys)
        found = self.used[at] & (self.slot_key[at] == keys)
        rest = np.flatnonzero(~found & self.used[at])
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.used) - 1)
            hit = self.used[at[rest]] & (self.slot_key[at[rest]] == keys[rest])
            found[rest[hit]] = True
            rest = rest[~hit & self.used[at[rest]]]
        out = self.value[at]
        if not found.all():
            out[~found] = 0
        return out, found


def sample_of(df: DataFrame, where: Column, text_col: str, lang_col: str, sample: int = SAMPLE,
              longest: int = LONGEST) -> DataFrame:
    """``(lang, text)``: at most ``sample`` distinct texts of each language
    among the rows that ``where`` selects, chosen by content hash."""
    rows = (df.where(where).select(c(lang_col).cast("string").alias("lang"), c(text_col).cast("string").alias("text"))
            .where(F.col("lang").isNotNull() & (F.octet_length("text") <= longest) & (F.length("text") > 0)))
    # about three times the sample passes a hash threshold per language, then the smallest hashes stay
    h = F.xxhash64("text")
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not counts:
        return rows.limit(0)
    shares = F.create_map(*[F.lit(x) for k, n in sorted(counts.items())
                            for x in (k, (2 ** 63 - 1) * min(3 * sample, n) // n)])
    few = rows.where(F.shiftrightunsigned(h, 1) <= shares[F.col("lang")]).select("lang", "text", h.alias("h")).distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return few.withColumn("r", rank).where(F.col("r") <= sample).select("lang", "text")


def train(df: DataFrame, where: Column, text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE,
          longest: int = LONGEST) -> Model | None:
    """Count the trees of every language; None if no labelled text passes.

    The counts that reach the driver are those of the bounded sample."""
    table = count_grams(sample_of(df, where, text_col, lang_col, sample, longest)).toArrow()
    return Model(table) if table.num_rows else None


def predict(df: DataFrame, model: Model | None, text_col: str = "text", lang_out: str = "lang_pred",
            score_out: str = "score") -> DataFrame:
    """``df`` with the predicted language and a score from 0 to 1 (the
    language's share under equal priors, from code lengths per byte).

    * ``und`` with score 0 if the text is null or has no letter, or if no
      model could be trained;
    * equal code lengths go to the language that is first by name;
    * columns of ``df`` named like the results are replaced; all others stay;
      an empty table gives an empty result.
    """
    spark = df.sparkSession
    keep = [x for x in df.columns if x not in (lang_out, score_out)]
    text = c(text_col).cast("string")
    has_letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    inner = df.select(*[c(x).alias(f"_c{i}") for i, x in enumerate(keep)],
                      F.when(has_letter, text).alias("_text"))
    shared = spark.sparkContext.broadcast(model)
    names = [f"_c{i}" for i in range(len(keep))]
    schema = T.StructType([*inner.schema.fields[:-1], T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])

    def run(batches):
        m = shared.value
        for rows, data, offs in text_steps(batches, "_text", STEP):
            n = rows.num_rows
            valid = rows.column(rows.schema.get_field_index("_text")).is_valid().to_numpy(zero_copy_only=False)
            lang, score = np.full(n, "und", object), np.zeros(n)
            pick = np.flatnonzero(valid & (np.diff(offs) > 0)) if m is not None else []
            if len(pick):
                bits = np.add.reduceat(m.byte_costs(data, offs), offs[pick], axis=0, dtype=np.float64)
                best = bits.argmin(axis=1)
                size = np.maximum(1, np.diff(offs)[pick])[:, None]
                lead = 16 * (bits.min(axis=1)[:, None] - bits) / size        # bits per 16 bytes
                lang[pick] = np.array(m.langs, object)[best]
                score[pick] = 1 / np.exp2(lead).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [rows.column(i) for i in range(len(names))] + [pa.array(lang, pa.string()), pa.array(score)],
                names=[*names, "_lang", "_score"])

    out = arrow_map(inner, run, schema)
    return out.select(*[F.col(f"_c{i}").alias(x) for i, x in enumerate(keep)],
                      F.col("_lang").alias(lang_out), F.col("_score").alias(score_out))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: CRC-32 of the id as text divisible by 5; a
    null id is not held out (and not trained on)."""
    return F.coalesce(F.crc32(c(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(id, held_out, lang_pred, score)``, one row per input row, by a model
    trained on the labelled rows that are not held out. Rows with a null id
    are judged too. The other columns of ``df`` take no part."""
    model = train(df, ~held_out(id_col) & c(id_col).isNotNull(), text_col, lang_col)
    rows = df.select(c(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), c(text_col).alias("text"))
    out = predict(rows, model)
    return out.select(F.col("doc_id").alias(id_col), "held_out", "lang_pred", "score")
