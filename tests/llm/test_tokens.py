"""Language ID, BPE and packing."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMOKE

from fundlens.llm import bpe, langid, packing
from fundlens.llm.queries import QUERIES, VOCABULARY
from fundlens.llm.words import Numbers

TOK = Tokenizer.from_file(VOCABULARY)
ODD = ["", "   ", None, "it's don't 're''s a!'s 'tis 're 'll've x'd's", "'", "''s", "'restaurant", "<|endoftext|> a <|startoftext|>b<|endoftext|",
       "İstanbul Σίσυφος ΣΑΣ", "été 日本語 1234 ²³ ½", "a\x1cb\x85c\xa0d e\u2003f", "z" * 17, "aaaa" * 3000, "!!!!!''''", "ǅ ǲ ŉ ſ", "😀😀 hi", "e\u0301 \u00e9"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_bpe_on_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(ODD)] + [(None, "null id", "x", "y"), (1, "again", "x", "y"), (1, "again", "x", "y")],
                               "doc_id long, text string, ids string, decoded string")
    out = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).collect()
    want = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (1, "again"), (1, "again")]
    got = sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in out), key=repr)
    assert got == sorted(((i, np.array(ids_of(t), "<u4").tobytes(), TOK.decode(ids_of(t), skip_special_tokens=False)) for i, t in want), key=repr)
    assert bpe.decode(bpe.encode(df.limit(0), VOCABULARY), VOCABULARY).collect() == []


def test_bpe_query_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe_codec"](spark, SMOKE).collect():
        ids = ids_of(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", max_codepoint=0x3FF), max_size=40) | st.text("abcdeinorst '!1", max_size=40), max_size=5))
def test_bpe_matches_the_library(texts):
    data = [t.encode() for t in texts]
    ids, at = bpe._encoder(VOCABULARY)[1].texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(b) for b in data]))
    for k, t in enumerate(texts):
        assert ids[at[k]:at[k + 1]].tolist() == ids_of(t)


def thue_morse(n, letters="ab"):
    word = "".join(letters[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


def encoded(encoder, texts):
    data = [t.encode() for t in texts]
    ids, at = encoder.texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(b) for b in data]))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("make", [lambda: bpe._encoder(VOCABULARY)[1], lambda: packing._encoder(VOCABULARY)])
def test_words_of_two_letters(make):
    """A Thue-Morse word and its complement cancel in any polynomial modulo 2^64; random long words of two letters."""
    rnd = random.Random(4)
    pairs = [thue_morse(n, ab) for n in (512, 1024, 2048, 4096) for ab in ("ab", "éè")]
    texts = [f"{a} {b}" for a, b in pairs] + [" ".join("".join(rnd.choice("ab") for _ in range(rnd.choice([3, 900, 1100]))) for _ in range(12)) for _ in range(8)]
    assert encoded(make(), texts) == [ids_of(t) for t in texts]


def test_new_words_are_encoded_together(monkeypatch):
    """The library gets thousands of Latin words as one text, and each gets the ids of its own; other words go alone."""
    asked = []

    class Counted:
        def __init__(self, tok):
            self.tok = tok

        def __getattr__(self, name):
            return getattr(self.tok, name)

        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return self.tok.encode_batch_fast(texts, **more)

    monkeypatch.setattr("tokenizers.Tokenizer", type("T", (), {"from_file": staticmethod(lambda path: Counted(Tokenizer.from_file(path)))}))
    encoder = packing._encoder.__wrapped__(VOCABULARY)
    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("abcdeorst\u00e9\u00df'!7") for _ in range(rnd.randrange(1, 12))) for _ in range(500)) for _ in range(10)]
    assert encoded(encoder, texts) == [ids_of(t) for t in texts]
    assert sum(asked) <= 5
    odd = [t for t in ODD if t] + ["</w> </ w > w</w>", "don't 's ''s 's't", "a \u0308b"]
    assert encoded(encoder, odd) == [ids_of(t) for t in odd]
    assert encoder.encode(["a", "\u65e5\u672c", "b"]) == [ids_of("a"), ids_of("\u65e5\u672c"), ids_of("b")]


def test_numbers_of_hashes():
    """Numbers follow the order of arrival, through growth and for neighbouring keys."""
    rnd = np.random.default_rng(3)
    numbers, seen = Numbers(), {}
    for most in (1 << 4, 1 << 12, 1 << 63):
        for _ in range(6):
            keys = rnd.integers(0, most, 30_000, dtype=np.uint64)
            got = numbers.find(keys)
            assert got.tolist() == [seen.get(k, -1) for k in keys.tolist()]
            new = np.unique(keys[got < 0])
            numbers.add(new)
            for k in new.tolist():
                seen[k] = len(seen)
            assert len(numbers) == len(seen) and numbers.keys[:len(numbers)].tolist() == list(seen)


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Even with a hash that sees only lengths the ids are right: words are compared."""
    monkeypatch.setattr("fundlens.llm.words.span_hashes", lambda low, s, e: (e - s).astype(np.uint64))
    encoder = bpe.WordEncoder(bpe._encoder(VOCABULARY)[0].encode_words, {}, most=50)
    texts = ["the cat", "cat the dog", "", "a " + "x" * 2000, "b " + "y" * 2000, "one two six", "the cat"]
    for _ in range(2):
        assert encoded(encoder, texts) == [ids_of(t) for t in texts]


def test_a_vocabulary_without_a_byte(tmp_path):
    spec = {"added_tokens": [], "model": {"vocab": {"a": 0, "a</w>": 1}, "merges": []}}
    path = tmp_path / "tiny.json"
    path.write_text(__import__("json").dumps(spec))
    vocabulary = bpe.Vocabulary(str(path))
    assert vocabulary.encode_word("aa") == [0, 1]
    with pytest.raises(ValueError, match="lacks a byte"):
        vocabulary.encode_word("ab")


def test_a_full_store_of_words_keeps_the_ids_right():
    rnd = random.Random(8)
    encoder = bpe.WordEncoder(bpe._encoder(VOCABULARY)[0].encode_words, {}, most=50)
    for _ in range(30):
        texts = [" ".join(rnd.choice(["the", "and", "house", "".join(rnd.choice("abcdef") for _ in range(5))]) for _ in range(20)) for _ in range(4)]
        data = [t.encode() for t in texts]
        ids, at = encoder.texts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(b) for b in data]))
        assert [ids[at[k]:at[k + 1]].tolist() for k in range(4)] == [ids_of(t) for t in texts]
        assert len(encoder.place) <= 50 + 80


@pytest.mark.parametrize("capacity,seed", [(16, 1), (64, 2), (2048, 3)])
def test_plan_uses_every_piece_once(capacity, seed):
    rnd = random.Random(seed)
    lengths = [rnd.randrange(1, capacity + 1) for _ in range(400)]
    hist = {s: lengths.count(s) for s in set(lengths)}
    used, sequences = {}, 0
    for pattern, times in packing.plan(hist, capacity):
        assert times > 0 and sum(s * a for s, a in pattern.items()) <= capacity
        sequences += times
        for s, a in pattern.items():
            used[s] = used.get(s, 0) + a * times
    assert used == hist and sequences <= math.ceil(sum(lengths) / capacity) * 1.05 + 1
    assert packing.plan({}, capacity) == []


@pytest.mark.parametrize("seed", range(3))
def test_every_solve_prices_and_proves_its_bound(seed):
    """Also where the first filling is good: the generation ends on the dual bound only."""
    rnd = random.Random(seed)
    for capacity, sizes in ((2048, [rnd.randrange(1, 2048) for _ in range(900)]), (300, [rnd.choice([110, 120, 155, 80]) for _ in range(500)]),
                            (100, [1] * 1000), (1000, [rnd.randrange(200, 900) for _ in range(700)])):
        histogram = {s: sizes.count(s) for s in set(sizes)}
        trace = []
        plan = packing.solve_patterns(histogram, capacity, trace=trace)
        total, bound = trace[-1]
        assert trace and total <= bound * (1 + packing.GAP)
        assert sum(v for _, v in plan) == pytest.approx(total)
        for s, n in histogram.items():
            assert sum(p.get(s, 0) * v for p, v in plan) == pytest.approx(n, rel=1e-6)


def test_column_generation_reaches_the_bound():
    """Three lengths whose greedy patterns waste space: the program must mix them."""
    solved = packing.solve_patterns({6: 100, 5: 200, 4: 100}, 15)
    assert sum(x for _, x in solved) <= (6 * 100 + 5 * 200 + 4 * 100) / 15 * 1.001


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pack(spark, capacity):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (1, "again and again"), (1, "again and again"), (99, "word " * 9000)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, start int, length string, _salt int")
    out = packing.pack(df, VOCABULARY, capacity=capacity).collect()
    got, want = [], []
    for i, t in rows:
        ids = np.array(ids_of(t) + [1], "<u4")
        want += [(i, s, len(p), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), capacity) for p in [ids[s:s + capacity]]]
    by_sequence = {}
    for r in out:
        got.append(tuple(r)[:5])
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(df.limit(0), VOCABULARY).collect() == []


def naive_bits(text, counts):
    """Code length of one text by walking the context tree byte by byte."""
    bits = 0.0
    data = b"\0" * langid.ORDER + text
    for k in range(langid.ORDER, len(data)):
        for n in range(langid.ORDER, -1, -1):
            seen = counts.get(data[k - n:k])
            if not seen:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if data[k] in seen:
                bits -= math.log2(seen[data[k]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    train = [("a", "abracadabra banana"), ("a", "cabana"), ("b", "xyzzy abba"), ("b", "été")]
    model = langid.train(spark.createDataFrame(train, "lang string, text string"), langid.F.lit(True))
    trees = {}
    for lang, text in train:
        data = b"\0" * langid.ORDER + text.encode()
        for k in range(langid.ORDER, len(data)):
            for n in range(langid.ORDER + 1):
                node = trees.setdefault(lang, {}).setdefault(data[k - n:k], {})
                node[data[k]] = node.get(data[k], 0) + 1
    for text in (b"abra", b"zebra \xc3\xa9t", b"\xff\xfe!", b"a"):
        got = model.byte_costs(np.frombuffer(text, np.uint8), np.array([0, len(text)])).sum(axis=0)
        assert np.allclose(got, [naive_bits(text, trees[x]) for x in model.langs], rtol=1e-5)


def test_language_query(spark):
    """Held-out accuracy on the given documents; labels of held-out rows and other columns are no inputs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = [(r.doc_id, r.lang) for r in docs.collect()]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [got[i].lang_pred == lang for i, lang in truth if got[i].held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.97
    hidden = langid.identify(docs.withColumn("lang", langid.F.when(~langid.held_out(), langid.F.col("lang"))))
    assert {r.doc_id: (r.lang_pred, r.score) for r in hidden.collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_edge_cases(spark):
    rows = [(i, f"the cat and the dog number {i}", "en", 1, "x") for i in range(30)] + [(i, f"der Hund und die Katze Nummer {i}", "de", 1, "x") for i in range(30, 60)]
    rows += [(60, None, "en", 1, "x"), (61, "", "de", 1, "x"), (62, "123 !? 4", "en", 1, "x"), (None, "the dog and the cat", None, 1, "x"),
             (63, "der Hund " * 9000, "de", 1, "x"), (1, "the cat", "en", 1, "x"), (1, "the cat", "en", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df).collect()]
    assert len(got) == len(rows)
    pred = dict(got)
    assert [pred[i] for i in (60, 61, 62, None, 63, 1)] == ["und", "und", "und", "en", "de", "en"]
    assert langid.identify(df.limit(0)).collect() == []
    unlabelled = langid.identify(df.withColumn("lang", langid.F.lit(None).cast("string")))
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    both = langid.predict(df, langid.train(df, langid.F.lit(True)))
    assert sorted(both.columns) == sorted(df.columns)


def test_training_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(500)] + [(1, "same", "de")] * 50, "doc_id long, text string, lang string")
    got = langid.sample_of(df, langid.F.lit(True), "text", "lang", sample=20).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"en": 20, "de": 1}
    assert public_tokenizers.path("word_bpe_49k.json") == VOCABULARY
