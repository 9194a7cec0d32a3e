"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is exactly one token that its encoding ends
with. The prefixes are visited from left to right; an automaton over all
tokens yields those that are suffixes of the prefix, and a token is the
prefix's last one if the rest of the prefix ends with a token that it is
compatible with. Two tokens are compatible if merging their joined symbols
gives just these two, which is decided on the right edge of one token's merge
tree and the left edge of the other's. The ids follow from the back-pointers.
Time is linear in a word's length, however long it is.
"""

from __future__ import annotations

import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from fundlens.llm.common import arrow_map, byte_view, c, ragged, text_steps
from fundlens.llm.words import WordEncoder

END = "</w>"
STEP = 1 << 19
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level
    vocabularies: printable Latin-1 bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """A merge vocabulary whose words end in ``</w>``.

    Inside, a word is a string of symbols: ``chr(byte)``, and
    ``chr(256 + byte)`` for the last byte of the word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        self.strings = [""] * (1 + max([*ids.values(), *self.specials.values()]))
        for s, i in [*ids.items(), *self.specials.items()]:
            self.strings[i] = s
        symbol = {ch: b for b, ch in enumerate(byte_letters())}
        self.left, self.right, self.rank = {}, {}, {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            t = ids[a + b]
            self.merge[ids[a], ids[b]] = r
            self.left[t], self.right[t], self.rank[t] = ids[a], ids[b], r
        self.fits: dict[int, bool] = {}
        self.tokens = ahocorasick.Automaton()
        for s, i in ids.items():
            body = s[:-len(END)] if s.endswith(END) else s
            if all(ch in symbol for ch in body) and body and self._alone(i):
                codes = [symbol[ch] for ch in body]
                codes[-1] += 256 * s.endswith(END)
                self.tokens.add_word("".join(map(chr, codes)), (i, len(codes)))
        self.tokens.make_automaton()

    def _joins(self, a: int, b: int) -> int:
        """Rank of the first merge across the border of a and b, if they are
        built side by side; ``_NEVER`` if there is none.

        Each edge is walked up from its single symbol. A node stays on the
        edge until its parent's merge, so two nodes stand side by side until
        the earlier of the two parents' ranks. Of equal merges the one further
        left comes first."""
        ups, t = [_NEVER], a
        edge_a = [a]
        while t in self.right:
            ups.append(self.rank[t])
            t = self.right[t]
            edge_a.append(t)
        downs, t = [_NEVER], b
        edge_b = [b]
        while t in self.left:
            downs.append(self.rank[t])
            t = self.left[t]
            edge_b.append(t)
        i, j = len(edge_a) - 1, len(edge_b) - 1
        while True:
            m = self.merge.get((edge_a[i], edge_b[j]))
            if m is not None and m < ups[i] and m <= downs[j]:
                return m
            if i == 0 and j == 0:
                return _NEVER
            if ups[i] <= downs[j]:
                i -= 1
            else:
                j -= 1

    def _alone(self, t: int) -> bool:
        """Whether the token's own string encodes to it (no earlier merge crosses its halves)."""
        if t not in self.left:
            return True
        a, b = self.left[t], self.right[t]
        return self._joins(a, b) == self.rank[t] and self._alone(a) and self._alone(b)

    def compatible(self, a: int, b: int) -> bool:
        key = a << 24 | b
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) > 250_000:
                self.fits.clear()
            fit = self.fits[key] = self._joins(a, b) == _NEVER
        return fit

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        last, size = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        compatible = self.compatible
        for end, (token, n) in self.tokens.iter(symbols):
            end += 1
            if last[end] < 0 and (n == end or (last[end - n] >= 0 and compatible(last[end - n], token))):
                last[end], size[end] = token, n
        out, at = [], len(raw)
        while at:
            if last[at] < 0:
                raise ValueError(f"the vocabulary has no tokens for {word!r}: it lacks a byte")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self.encode_word(w) for w in words]


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[Vocabulary, WordEncoder]:
    """One per Python worker: the vocabulary and its store of encoded words."""
    vocab = Vocabulary(path)
    return vocab, WordEncoder(vocab.encode_words, vocab.specials)


@lru_cache(maxsize=2)
def _decoder(path: str) -> tuple[np.ndarray, np.ndarray]:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    strings = {**{i: s for s, i in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
    parts = [(strings.get(i, "") + " ").encode() for i in range(max(strings) + 1)]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the token ids of each whole text as little-endian
    unsigned 32-bit integers in one binary value.

    * null and empty texts, and texts of white space, have no ids;
    * strings of special tokens inside a text become their ids;
    * one row per input row, repeated rows too, null ids kept; other columns
      (whatever their names) are ignored; an empty table gives an empty
      result. ``path`` must be readable where the tasks run.
    """
    rows = df.select(c(id_col).alias("doc_id"), c(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["doc_id"], StructField("ids", BinaryType())])

    def run(batches):
        _, encoder = _encoder(path)
        for part, data, offs in text_steps(batches, "text", STEP):
            ids, at = encoder.texts(data, offs)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.Array.from_buffers(pa.binary(), part.num_rows, [
                    None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])], names=["doc_id", "ids"])

    return arrow_map(rows, run, schema).withColumnRenamed("doc_id", id_col)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, ids, decoded)``: token strings joined by spaces, special tokens
    included, as this vocabulary (which has no decoder) decodes. Null ids
    decode to the empty text; an id outside the vocabulary to nothing."""
    rows = df.select(c(id_col).alias("doc_id"), c(ids_col).alias("ids"))
    schema = StructType([*rows.schema.fields, StructField("decoded", StringType())])

    def run(batches):
        pool, at = _decoder(path)
        size = np.diff(at)
        for rb in batches:
            for part, data, offs in _binary_steps(rb, STEP):
                ids = data.view("<u4").astype(np.int64)
                ids = np.where(ids < len(size), ids, 0)
                lengths = size[ids]
                text = pool[ragged(at[ids], lengths)]
                ends = np.concatenate([[0], np.cumsum(lengths)])[offs // 4]
                keep = np.ones(len(text), bool)
                keep[ends[1:][np.diff(ends) > 0] - 1] = False        # the space behind a text's last token
                bounds = ends - np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.Array.from_buffers(pa.string(), part.num_rows, [
                        None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text[keep])])], names=["doc_id", "ids", "decoded"])

    return arrow_map(rows, run, schema).withColumnRenamed("doc_id", id_col).withColumnRenamed("ids", ids_col)


def _binary_steps(rb: pa.RecordBatch, step: int):
    col = rb.column(1).fill_null(b"").cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, rb.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, "right")) - 1)
        yield rb.slice(i, j - i), np.ascontiguousarray(data[offs[i]:offs[j]]), offs[i:j + 1] - offs[i]
        i = j
