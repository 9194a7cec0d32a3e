"""Conversation prefix trie against a plain recursive version."""

import hashlib
import random
import zlib

import pytest

from fundlens.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role, text):
    role, text = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(role)).encode() + b":" + role + text).digest()


def rebuild(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((turn is not None, turn, turn_digest(role, text), role or "", text or ""))
    by = {c: [x[3:] for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = by.get(base, [])[:h] + own[h:]
    return out


def brute(sequences):
    """``{id: [turn]}`` -> rows of the trie."""
    members = {}
    for i, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(i)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = set()

    def walk(k):
        kids = [walk(x) for x in children.get(k, [])]
        saved = (len(members[k]) - 1) * (len(k[-1][-1].encode()) if k else 0) + sum(s for _, s in kids)
        leaves = sum(n for n, _ in kids) or 1
        ends = ",".join(map(str, sorted(i for i in members[k] if len(sequences[i]) == len(k))))
        out.add((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        walk(())
    return out


def result(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "conv_id long, turn long, role string, text string, depth string, name int"


@pytest.mark.parametrize("height", [2, 3, 16])
def test_trie(spark, height):
    rnd = random.Random(height)
    texts = ["", None, "a", "é", "yes\nno", "x" * 20_000]
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for c in range(-12, 40) if c % 7
            for t in range(rnd.choice([0, 1, 2, 5, 12, 30]))]
    rows += [(5, None, "user", "null turn"), (5, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "no id"), (1003, 1, None, None)]
    rows += [(c, t, "user", f"m{t}") for c in (200, 201, 202, 203, 204, 305, 306) for t in range(40)]      # hot prefix
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    assert result(trie.conversation_trie(df, height=height)) == brute(rebuild(rows))


def test_long_conversation(spark):
    """One conversation far deeper than a band, another that leaves it late: several levels of bands."""
    rows = [(10, t, "user", f"t{t}") for t in range(700)] + [(15, t, "user", f"t{t}" if t < 650 else "other") for t in range(700)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert result(trie.conversation_trie(df, height=4)) == brute_chain(rebuild(rows))


def brute_chain(sequences):
    import sys
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(5000)
    try:
        return brute(sequences)
    finally:
        sys.setrecursionlimit(old)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert result(trie.conversation_trie(df)) == set()
    # ids whose head exceeds their own turns and whose base is absent: members of the root only
    lone = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:3]
    rows = [(c, 0, "user", "gone") for c in lone]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = result(trie.conversation_trie(df))
    assert got == brute(rebuild(rows)) and len(got) == 1


def test_ids_joined_over_rows(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_ROW", 3)
    rows = [(c, 0, "user", "hi") for c in range(0, 100, 5)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    assert result(trie.conversation_trie(df)) == brute(rebuild(rows))
