"""Helpers shared by the operators: Arrow batches to byte arrays, vectorised
ragged copies, word hashing, and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlens.session import ensure_checkpoint_dir

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
CHUNK_BYTES = 1 << 19


def c(name: str) -> Column:
    """A column by its literal name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


class Scratch:
    """Tables of one operator run in the shared folder. ``discard`` deletes
    them once everything that reads them has been written itself."""

    def __init__(self):
        self._made: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage: write ``df`` as Parquet to the shared folder that
        ``spark.checkpoint.dir`` names and read it back. Survives lost
        executors, and Python stages behind it run once however often it is
        read."""
        spark = df.sparkSession
        path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._made.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        while self._made:
            spark, path = self._made.pop()
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``Scratch.written`` for a table that the result itself reads."""
    return Scratch().written(df, name)


#: Bytes of an Arrow batch between the JVM and a Python worker: each task holds a few of them off heap.
BATCH_BYTES = 8 << 20


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_BYTES`` (or what the
    session asks for, if less). Texts differ in size by orders of magnitude,
    so a row count does not bound a task's memory. The setting is the
    session's, as the plan reads it when it runs. When a task ends, its Python
    worker, which stays for later tasks, gives unused memory back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, "64m").lower()
    size = int(float(re.match(r"[0-9.]+", now)[0]) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1], 1))
    if size > BATCH_BYTES:
        df.sparkSession.conf.set(key, f"{BATCH_BYTES}b")

    def task(batches):
        yield from run(batches)
        release_memory()

    return df.mapInArrow(task, schema)


def release_memory() -> None:
    """Return freed memory of this process to the system, where that is possible."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string column as UTF-8 bytes, or of a binary
    column, whose bytes need not be UTF-8; null is empty.

    ``offsets`` are absolute positions in ``data``."""
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(b"", pa.binary()).cast(col.type))
    if not (pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)):
        col = col.cast(pa.large_string())
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_steps(batches, text: str, step: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into steps of about ``step`` text bytes (at least
    one row): ``(rows, data, offsets)`` with ``offsets`` from 0."""
    for rb in batches:
        if not rb.num_rows:
            continue
        data, offs = byte_view(rb.column(rb.schema.get_field_index(text)))
        i, n = 0, rb.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + step, "right")) - 1)
            yield rb.slice(i, j - i), data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
            i = j


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i]`` of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place on a fresh array)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Two odd bases and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, base: int = 0) -> np.ndarray:
    """``base^i mod 2^64`` for i < n; grown by doubling and kept up to 1M."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(_BASES[base], -1 if inverse else 1, 1 << 64)
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        k = 1
        while k < size:
            have[k:2 * k] = have[:k] * np.uint64(pow(b, k, 1 << 64))
            k *= 2
        if size <= 1 << 20:
            _POWERS[base, inverse] = have
    return have[:n]


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each byte of ``data`` on as one little-endian number (zeros behind the end); a view of a copy."""
    raw = np.concatenate([np.ascontiguousarray(data).view(np.uint8), np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


#: Mask of the first n bytes of a lane.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that are folded lane by lane; a longer span is the span of its blocks' hashes.
_BLOCK = 1024


def _fold(view: np.ndarray, at: np.ndarray, size: np.ndarray, level: int = 0) -> np.ndarray:
    h = mix64(size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(2 * level + 1))
    short = size <= _BLOCK
    live = np.flatnonzero(short & (size > 0))
    pos, left = at[live], size[live]
    while len(live):
        h[live] = mix64(h[live] ^ (view[pos] & _BYTES[np.minimum(left, 8)]))
        keep = left > 8
        live, pos, left = live[keep], pos[keep] + 8, left[keep] - 8
    long = np.flatnonzero(~short)
    if len(long):
        count = -(-size[long] // _BLOCK)
        first = np.cumsum(count) - count
        inside = _BLOCK * (np.arange(int(count.sum())) - np.repeat(first, count))
        blocks = _fold(view, np.repeat(at[long], count) + inside, np.minimum(_BLOCK, np.repeat(size[long], count) - inside), level + 1)
        h[long] ^= _fold(lanes(blocks), 8 * first, 8 * count, level + 2)
    return h


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span ``symbols[start:end]``: its bytes in lanes of
    eight, chained through ``mix64``, so that no sum of symbol values can cancel."""
    width = symbols.itemsize
    return _fold(lanes(symbols), np.asarray(starts, np.int64) * width, (np.asarray(ends, np.int64) - starts) * width)


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes are equal at places of two lane views (``lanes``)."""
    out = np.ones(len(size), bool)
    live = np.flatnonzero((size > 0) & (size <= _BLOCK))
    left = size[live]
    step = 0
    while len(live):
        out[live] &= ((a[at_a[live] + step] ^ b[at_b[live] + step]) & _BYTES[np.minimum(left, 8)]) == 0
        keep = left > 8
        live, left, step = live[keep], left[keep] - 8, step + 8
    for i in np.flatnonzero(size > _BLOCK).tolist():
        n, x, y = int(size[i]), int(at_a[i]), int(at_b[i])
        out[i] = np.array_equal(a[x:x + n - 7:8], b[y:y + n - 7:8]) and a[x + n - 8] == b[y + n - 8]
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
