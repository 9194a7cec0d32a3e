"""Grouping genetic packing: valid plans, planted optima, whole documents against the tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fundlens.llm import genetic

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def valid(individual, sizes, capacity):
    assert sorted(i for b in individual.bins for i in b) == list(range(len(sizes)))
    for b, room in zip(individual.bins, individual.room):
        assert b and room == capacity - sum(sizes[i] for i in b) >= 0


def planted(rnd, capacity, bins):
    """Bins cut into two to five pieces: the optimum is ``bins`` full ones."""
    out = []
    for _ in range(bins):
        cuts = sorted(rnd.sample(range(1, capacity), rnd.randrange(1, 5)))
        out += [b - a for a, b in zip([0, *cuts], [*cuts, capacity])]
    return sorted(out, reverse=True)


@pytest.mark.parametrize("seed", range(4))
def test_crossover_and_evolution(seed):
    rnd = random.Random(seed)
    sizes = planted(rnd, 1000, 60)
    founders = genetic.founders(sizes, 1000, rnd, 6)
    for x in founders:
        valid(x, sizes, 1000)
    for _ in range(30):
        a, b = rnd.choice(founders), rnd.choice(founders)
        before = [list(x) for x in a.bins], [list(x) for x in b.bins]
        child = genetic.crossover(a, b, sizes, 1000, rnd)
        valid(child, sizes, 1000)
        assert ([list(x) for x in a.bins], [list(x) for x in b.bins]) == before       # parents are not changed
        assert {tuple(x) for x in child.bins} & {tuple(x) for x in b.bins}            # whole bins come from the giver
    evolved = genetic.evolve(sizes, 1000, founders, "seed", children=200)
    valid(evolved[0], sizes, 1000)
    assert evolved[0].fitness > max(x.fitness for x in founders)
    assert [x.fitness for x in evolved] == sorted((x.fitness for x in evolved), reverse=True)
    again = genetic.Individual.of(evolved[0].places(len(sizes)), sizes, 1000)
    assert again.fitness == evolved[0].fitness


@pytest.mark.parametrize("group", [64, 512])
def test_pack_pieces(spark, group):
    rnd = random.Random(group)
    lengths = planted(rnd, 500, 120) + [500] * 7 + [260] * 40 + [3] * 200
    rnd.shuffle(lengths)
    df = spark.createDataFrame([(i % 50, n) for i, n in enumerate(lengths)], "doc_id long, length long")      # repeated ids and rows
    got = genetic.pack_pieces(df, 500, group).collect()
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i % 50, n) for i, n in enumerate(lengths))
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 500
    assert len(sequences) <= 1.03 * sum(lengths) / 500 + 1


def test_large_pieces_only(spark):
    """No two fit together: every piece is a sequence, and the rounds end."""
    df = spark.createDataFrame([(i, 300) for i in range(400)], "doc_id long, length long")
    assert genetic.pack_pieces(df, 500, 32).select("sequence_id").distinct().count() == 400


def test_pack(spark):
    tok = Tokenizer.from_file(VOCABULARY)
    tok.no_truncation()
    tok.no_padding()
    rows = [(1, None), (2, ""), (3, "The cat, the hat."), (3, "The cat, the hat."), (None, "no id"), (4, "word " * 200), (5, "été 日本 " * 60), (6, "a b " * 16)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, piece int, length string")
    got = genetic.pack(df, VOCABULARY, capacity=32).collect()
    want = []
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 32)):
            part = ids[s:s + 32]
            want.append((i, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(tuple(r)[:5] for r in got if r.doc_id) == sorted(w for w in want if w[0])
    assert len(got) == len(want)
    assert genetic.pack(df.limit(0), VOCABULARY).collect() == []
