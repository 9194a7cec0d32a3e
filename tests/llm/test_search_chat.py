"""Exact top-k search and chat formatting against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import chat, topk


def best(rows, k, scale=256):
    vecs = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in vecs if i % 50 == 0}:
        found = {}
        for qi, qv in vecs:
            if qi == q:
                for at, (i, v) in enumerate(vecs):
                    if i != q and len(v) == len(qv) and abs(sum(a * b for a, b in zip(qv, v))) < 1 << 63:
                        s = sum(a * b for a, b in zip(qv, v))
                        found[at] = max(found.get(at, (s, -i)), (s, -i))
        for rank, (s, i) in enumerate(sorted(found.values(), reverse=True)[:k], 1):
            out.add((q, rank, -i, s))
    return out


@pytest.mark.parametrize("blocks", [(2048, 16384), (2, 7)])
def test_top_k(spark, blocks):
    rnd = random.Random(5)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(40)]) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(200, 230)]                         # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 40), (350, [float("inf")] * 40), (None, rows[0][1]),
             (400, [0.5, 0.25]), (401, [0.5, -0.25]), (450, []), (451, []), (7, rows[7][1]), (500, [1e30] * 2), (550, [2.0 ** 20] * 2), (600, [1e307] * 2)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, query_block=blocks[0], row_block=blocks[1]).collect()
    assert {tuple(r) for r in got} == best([r for r in rows if r[0] != 600], 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_search_block_beyond_doubles():
    ids = np.arange(4)
    vecs = np.array([[2.0 ** 40, 1], [2.0 ** 40, 2], [2.0 ** 40, 3], [0, 0]])
    _, rows, scores = topk.search_block(np.array([0]), vecs[:1], ids, vecs, 2)
    assert rows.tolist() == [2, 1] and [int(s) for s in scores] == [2 ** 80 + 3, 2 ** 80 + 2]


def chats():
    nasty = [chat.PROBE_TEXT, "\\", "\\l<s>[b\\\\", "", None, "plain", "é<[\\日本", "<s></s>[INST][/INST]", "x" * 30_000]
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "</s>", "tool[INST]"]), rnd.choice(nasty))
            for c in [*range(12), None] for t in range(rnd.randrange(1, 30))]
    return rows + [(1, 0, "assistant", "again"), (1, 0, "assistant", "again"), (2, None, "user", "no turn")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 50])
def test_chat_round_trip(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(chat, "PART_BYTES", part_bytes)
    rows = chats()
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, part int, formatted string")
    parts = chat.format_chats(df)
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((t, role, text))
    null_first = lambda x: (x is not None, x)
    whole = {}
    for r in parts.collect():
        whole.setdefault(r.conv_id, []).append((r.part, bytes(r.formatted), r.turn_ends))
    for r in chat.read_back(parts).collect():
        turns = [((role or "").encode(), (text or "").encode())
                 for _, role, text in sorted(by_conv.pop(r.conv_id), key=lambda x: tuple(map(null_first, x)))]
        loss = b"".join(text for role, text in turns if role == b"assistant")
        text = b"".join(p[1] for p in sorted(whole[r.conv_id]))
        assert list(chat.parse_turns(text)) == turns
        assert text.count(b"</s>") == len(turns) == sum(len(p[2]) for p in whole[r.conv_id])
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(b"".join(a + b"\n" + b + b"\n" for a, b in turns)).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss.decode()), hashlib.sha256(loss).hexdigest())
        assert r.formatted_chars == len(text.decode())
    assert not by_conv
    assert chat.read_back(chat.format_chats(df.limit(0))).collect() == []


def test_probe(spark):
    df = spark.createDataFrame([(4, 0, "user", "hi", 1)], "conv_id long, turn long, role string, text string, extra int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.with_probe(df))).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(chat.PROBE_TEXT) and got[4].loss_chars == 0
