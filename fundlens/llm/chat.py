r"""Chat formatting: columnar byte assembly.

Turns are grouped by conversation and ordered; a task then builds the
formatted bytes of many turns at once: numpy computes the length of every
segment (header, role, content, footer), cumulative offsets and scatter
indices, and copies headers and contents into one preallocated buffer, which
becomes an Arrow binary column without a further copy.

Template, one turn: ``[INST]role[/INST]text</s>``; a conversation starts
with ``<s>``. Inside roles and texts ``\`` becomes ``\\``, ``<`` becomes
``\l`` and ``[`` becomes ``\b``, so no control string can occur there, and
the escape is undone exactly.

A conversation is emitted in parts of bounded size, in order, so that one of
any length passes through its task as a stream.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundlens.llm.common import arrow_map, byte_view, c, partitions, ragged

OPEN, ROLE, BODY, CLOSE = b"<s>", b"[INST]", b"[/INST]", b"</s>"
#: byte -> the letter that follows ``\`` in its escaped form
ESCAPES = {ord("\\"): ord("\\"), ord("<"): ord("l"), ord("["): ord("b")}
_CODE = np.zeros(256, np.uint8)
for _b, _e in ESCAPES.items():
    _CODE[_b] = _e
_PLAIN = np.zeros(256, np.uint8)
for _b, _e in ESCAPES.items():
    _PLAIN[_e] = _b
_SLASH = ord("\\")

#: Turns are cut into parts of about this many text bytes.
PART_BYTES = 1 << 20

PART_SCHEMA = ("conv_id long, part long, formatted binary, turn_ends array<long>, "
               "mask_starts array<long>, mask_lengths array<long>")


def escape(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Escape the segments ``data[offs[i]:offs[i+1]]``: new data and offsets."""
    code = _CODE[data]
    special = np.flatnonzero(code)
    at = np.arange(len(data)) + np.concatenate([[0], np.cumsum(code != 0)])[:-1]
    out = np.empty(len(data) + len(special), np.uint8)
    out[at] = data
    out[at[special]] = _SLASH
    out[at[special] + 1] = code[special]
    return out, offs + np.searchsorted(special, offs)


def unescape(data: bytes) -> bytes:
    """Inverse of ``escape`` on one segment."""
    if b"\\" not in data:
        return data
    out, i = bytearray(), 0
    while (j := data.find(b"\\", i)) >= 0:
        out += data[i:j]
        out.append(_PLAIN[data[j + 1]])
        i = j + 2
    return bytes(out + data[i:])


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray],
             first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of turns: ``(buffer, turn offsets, content starts,
    content lengths)``. ``first`` marks turns that open a conversation."""
    role, role_offs = escape(*roles)
    text, text_offs = escape(*texts)
    n = len(first)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    consts = np.frombuffer(OPEN + ROLE + BODY + CLOSE, np.uint8)
    const_at = np.cumsum([0, len(OPEN), len(ROLE), len(BODY)])
    source = np.concatenate([consts, role, text])
    seg_start = np.empty((n, 6), np.int64)
    seg_len = np.empty((n, 6), np.int64)
    for k, (start, length) in enumerate([
            (const_at[0], np.where(first, len(OPEN), 0)), (const_at[1], len(ROLE)),
            (len(consts) + role_offs[:-1], np.diff(role_offs)), (const_at[2], len(BODY)),
            (len(consts) + len(role) + text_offs[:-1], np.diff(text_offs)), (const_at[3], len(CLOSE))]):
        seg_start[:, k], seg_len[:, k] = start, length
    ends = np.cumsum(seg_len.ravel())
    buffer = np.empty(int(ends[-1]), np.uint8)
    np.take(source, ragged(seg_start.ravel(), seg_len.ravel()), out=buffer)
    ends = ends.reshape(n, 6)
    return buffer, np.concatenate([[0], ends[:, 5]]), ends[:, 3], seg_len[:, 4]


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """``(conv_id, part, formatted, turn_ends, mask_starts, mask_lengths)``.

    The parts of a conversation, in order of ``part`` (from 0), concatenate
    to its formatted bytes and lie one after another in one partition.
    ``turn_ends`` are the ends of the turns within the part; the mask spans
    are the escaped texts of ``trained_role`` (the loss mask).

    * rows go by turn; equal or null turns by role, then text (null first);
    * null role or text counts as empty; null conversation ids are one
      conversation; repeated rows are turns of their own;
    * other columns (whatever their names) are ignored; an empty table gives
      an empty result.
    """
    rows = df.select(c(conv_col).cast("long").alias("conv_id"), c(turn_col).alias("turn"),
                     c(role_col).cast("string").alias("role"), c(text_col).cast("string").alias("text"))
    rows = (rows.repartition(partitions(df.sparkSession), "conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn"))
    trained = trained_role.encode()

    def run(batches):
        last, part = object(), 0
        for rb in batches:
            if not rb.num_rows:
                continue
            ids = rb.column(0).to_pylist()
            roles, texts = byte_view(rb.column(1)), byte_view(rb.column(2))
            new = np.array([a != b for a, b in zip(ids, [last] + ids[:-1])])
            size = np.diff(texts[1]) + np.diff(roles[1])
            cuts, held = [0], 0
            for i in range(len(ids)):              # parts: one conversation, about PART_BYTES
                if i > cuts[-1] and (new[i] or held + size[i] > PART_BYTES):
                    cuts.append(i)
                    held = 0
                held += int(size[i])
            cuts.append(len(ids))
            lo = 0
            while lo < len(cuts) - 1:              # steps of a few parts, one buffer each
                hi = lo + 1
                while hi < len(cuts) - 1 and size[cuts[lo]:cuts[hi + 1]].sum() <= 8 * PART_BYTES:
                    hi += 1
                a, b = cuts[lo], cuts[hi]
                view = lambda v: (v[0][v[1][a]:v[1][b]], v[1][a:b + 1] - v[1][a])
                buffer, turn_offs, starts, lengths = assemble(view(roles), view(texts), new[a:b])
                rdata, roffs = view(roles)
                is_trained = np.array([rdata[roffs[i]:roffs[i + 1]].tobytes() == trained for i in range(b - a)])
                edges = np.array(cuts[lo:hi + 1]) - a
                ends, m_start, m_len, numbers = [], [], [], []
                for s, e in zip(edges[:-1], edges[1:]):
                    part = 0 if new[a + s] else part + 1
                    numbers.append(part)
                    base = turn_offs[s]
                    pick = np.flatnonzero(is_trained[s:e]) + s
                    ends.append(turn_offs[s + 1:e + 1] - base)
                    m_start.append(starts[pick] - base)
                    m_len.append(lengths[pick])
                yield pa.record_batch({
                    "conv_id": pa.array([ids[a + s] for s in edges[:-1]], pa.int64()), "part": pa.array(numbers, pa.int64()),
                    "formatted": pa.Array.from_buffers(pa.binary(), len(edges) - 1, [
                        None, pa.py_buffer(turn_offs[edges].astype(np.int32)), pa.py_buffer(buffer)]),
                    "turn_ends": pa.array(ends, pa.list_(pa.int64())),
                    "mask_starts": pa.array(m_start, pa.list_(pa.int64())),
                    "mask_lengths": pa.array(m_len, pa.list_(pa.int64()))})
                lo = hi
            last = ids[-1]

    return arrow_map(rows, run, PART_SCHEMA)


def parse_turns(formatted: bytes):
    """``(role, text)`` of each turn of a formatted part, unescaped."""
    at = len(OPEN) if formatted.startswith(OPEN) else 0
    while at < len(formatted):
        body = formatted.index(BODY, at)
        close = formatted.index(CLOSE, body)
        yield unescape(formatted[at + len(ROLE):body]), unescape(formatted[body + len(BODY):close])
        at = close + len(CLOSE)


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of ``format_chats``' output, one row per conversation, read
    from the formatted bytes and the loss mask alone. A conversation's parts
    pass one after another; only hash states are kept."""

    def run(batches):
        state = None
        done = []

        def flush():
            if state is not None:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for rb in batches:
            for row in rb.select(["conv_id", "part", "formatted", "mask_starts", "mask_lengths"]).to_pylist():
                if row["part"] == 0:
                    flush()
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["formatted"]
                for role, body in parse_turns(text):
                    state[1] += 1
                    state[2].update(role + b"\n" + body + b"\n")
                for s, n in zip(row["mask_starts"], row["mask_lengths"]):
                    loss = unescape(text[s:s + n])
                    state[3] += code_points(loss)
                    state[4].update(loss)
                state[5] += code_points(text)
            if len(done) >= 4096:
                yield _digest_batch(done)
                done.clear()
        flush()
        if done:
            yield _digest_batch(done)

    return arrow_map(parts, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")


def _digest_batch(rows):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))})


#: The conversation that the registered query adds: fixed values.
PROBE_ID = -1
PROBE_TEXT = "</s>[INST] ok [/INST]"


def with_probe(df: DataFrame) -> DataFrame:
    """The conversations and one whose texts hold the control strings."""
    probe = df.sparkSession.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
        "conv_id long, turn long, role string, text string")
    return df.select("conv_id", "turn", "role", "text").unionByName(probe)
