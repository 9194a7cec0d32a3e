"""Near-duplicates, substrings and lines against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from brute import kept_lines, near_components, substring_digest

from fundlens.llm import graph, lines, minhash, suffix_dedup
from fundlens.llm.common import Scratch, byte_view, lanes as lane_view, same_bytes, span_hashes
from fundlens.llm.queries import QUERIES


def word(rnd):
    return "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 5)))


def copies(seed, n=60):
    """Originals with copies that have ever more words replaced, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(seed)
    rows = []
    for g in range(4):
        base = [word(rnd) for _ in range(rnd.choice([6, 40, 150]))]
        for k in range(n // 4):
            w = list(base)
            for _ in range(rnd.randrange(0, 1 + len(w) // 20)):
                w[rnd.randrange(len(w))] = word(rnd)
            rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_dedup(spark, size):
    texts = copies(size) + [None, "", " \t", "one two", "ONE two", "One\x0btwo", "one two three", "long " * 30_000, "é " * 9]
    ids = list(range(100, 100 + len(texts)))
    rows = list(zip(ids, texts)) + [(100, texts[0]), (100, texts[1]), (None, texts[0]), (None, "alone with a null id here"), (7, "one two")]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, digest string, kept string, n int")
    got = minhash.near_dedup(df, size=size, percent=80).collect()
    want = near_components(rows, size, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=repr) == sorted(
        ((i, n, i if not n else comp, (i if not n else comp) == i) for (i, _), (n, comp) in zip(rows, want.values())), key=repr)


def test_near_dedup_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_dedup(df).collect() == []


def test_near_dedup_settles_a_bucket_without_a_common_link(spark):
    """A chain of texts: each is linked with its neighbours only."""
    w = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(w[i * 5:i * 5 + 100])) for i in range(40)]
    rows += [(i + 1000, " ".join(w[i * 30:i * 30 + 100])) for i in range(8)]      # overlaps of 70 %: no links
    got = {r.doc_id: r.component_id for r in minhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    want = near_components(rows, 4, 80)
    assert got == {i: want[k][1] for k, (i, _) in enumerate(rows)}


def open_pairs(spark, sets, roots, percent):
    """Joined rows of ``_open_pairs`` for sets of integers."""
    name = [k.to_bytes(4, "big") for k in range(len(sets))]
    nodes = spark.createDataFrame([(name[k], name[r]) for k, r in enumerate(roots)], "node binary, root binary")
    table = spark.createDataFrame([(name[k], sorted(s)) for k, s in enumerate(sets)], "digest binary, elements array<long>")
    found = minhash._open_pairs(nodes, table, percent, Scratch()).collect()
    return [tuple(sorted(int.from_bytes(bytes(v), "big") for v in r)) for r in found]


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_open_pairs_lose_no_link(spark, percent):
    """Every link between different roots is among the pairs, ties at the threshold included."""
    rnd = random.Random(percent)
    sets = []
    for g in range(6):
        base = rnd.sample(range(g * 40, g * 40 + 90), rnd.choice([1, 4, 9, 36, 45]))
        for _ in range(12):
            keep = rnd.sample(base, max(1, len(base) - rnd.randrange(0, 1 + len(base) // 4)))
            sets.append(set(keep) | set(rnd.sample(range(1000), rnd.randrange(0, 1 + len(base) // 9))))
    roots = [rnd.randrange(len(sets)) if rnd.random() < 0.5 else 3 for _ in sets]
    got = set(open_pairs(spark, sets, roots, percent))
    want = {(x, y) for y in range(len(sets)) for x in range(y) if roots[x] != roots[y]
            and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y])}
    assert want and want <= got and all(roots[x] != roots[y] for x, y in got)


def test_open_pairs_of_a_hot_text_grow_with_its_members(spark):
    """2,000 excerpts of one text, and 2,000 copies with words of their own: of 4 million pairs, no more rows are joined
    than a member has shingles that it is met under (20 of 100)."""
    rnd = random.Random(5)
    starts = sorted(rnd.randrange(4000) for _ in range(2000))
    sets = [set(range(s, s + 100)) for s in starts]              # neighbours are linked: a new root where the distance is too large
    roots = [0] * 2000
    for k in range(1, 2000):
        roots[k] = roots[k - 1] if starts[k] - starts[k - 1] <= 11 else k
    sets.append(set(range(4100)))                                # the text itself is linked with none of them
    roots.append(2000)
    other = [set(rnd.sample(range(10_000, 10_100), 85)) | {20_000 + 20 * k + j for j in range(15)} for k in range(2000)]
    shift = len(sets)
    got = open_pairs(spark, sets + other, roots + [shift + k for k in range(2000)], 80)
    assert len(got) <= 20 * (len(sets) + len(other))
    assert not [p for p in got if p[1] >= shift]                 # no two of the copies are joined


def test_registers_estimate_similarity():
    rnd = np.random.default_rng(3)
    a = np.unique(rnd.integers(0, 2 ** 63, 2000, dtype=np.int64).view(np.uint64))
    b = np.unique(np.concatenate([a[:1600], rnd.integers(0, 2 ** 63, 400, dtype=np.int64).view(np.uint64)]))
    regs = minhash.sketch([a, b], 2048)
    equal = (regs[0] == regs[1]).mean()
    chance = minhash.chance_table()[11]
    assert 0 < chance < 1e-3
    assert abs((equal - chance) / (1 - chance) - 1600 / 2400) < 0.04


def test_components(spark):
    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 200), rnd.randrange(100, 200)) for _ in range(90)] + [(70, 70)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), Scratch()).collect()}
    parent = {x: x for e in links for x in e}
    top = lambda x: x if parent[x] == x else top(parent[x])
    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    assert got == {x: top(x) for x in parent if x != 70}


@pytest.mark.parametrize("width,most", [(6, 32768), (6, 1), (40, 32768), (40, 2)])
def test_substrings(spark, width, most):
    rnd = random.Random(width + most)
    base = ["".join(rnd.choice("abc é") for _ in range(rnd.randrange(0, 200))) for _ in range(12)]
    texts = base + [base[1], base[2][:90] + "XY" + base[3][20:], base[4] + base[5], None, "", "a" * 150, "ab" * 60, "q" * (width - 1)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (3, "other " * 9), (None, base[6]), (None, "null id " * 3)]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, tk int, lo string, carry string")
    got = suffix_dedup.digest(suffix_dedup.dedup_substrings(df, width=width, most=most)).collect()
    want = substring_digest([t for _, t in rows], width)
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, want)), key=repr)


def test_byte_view_of_split_characters():
    """Pieces start and end at any byte of a character."""
    for kind in (pa.binary(), pa.large_binary()):
        data, offs = byte_view(pa.array([b"\xa9 a", None, b"a \xc3"], kind))
        assert data.tobytes() == b"\xa9 aa \xc3" and offs.tolist() == [0, 3, 3, 6]
    data, offs = byte_view(pa.array(["é", None, "a"]))
    assert data.tobytes() == "éa".encode() and offs.tolist() == [0, 2, 2, 3]


def test_substrings_of_a_hot_passage_between_accented_text(spark):
    """More than ``most`` documents share a passage; the pieces at its borders
    differ in each and cut characters of two and three bytes."""
    rnd = random.Random(11)
    around = lambda n: "".join(rnd.choice("éñü€") for _ in range(n))
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(70))
    rows = [(i, around(40) + passage + around(40)) for i in range(12)] + [(12, around(90)), (13, passage[:39] + around(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.digest(suffix_dedup.dedup_substrings(df, width=40, most=4)).collect()
    want = substring_digest([t for _, t in rows], 40)
    assert sorted(map(tuple, got)) == sorted((i, *w) for (i, _), w in zip(rows, want))
    assert all(r.n_removed >= 70 for r in got if r.doc_id < 12)


def test_substrings_empty_and_carried(spark):
    df = spark.createDataFrame([(1, "abc" * 200, "s")], "doc_id long, text string, `so.urce` string")
    assert suffix_dedup.dedup_substrings(df.limit(0)).collect() == []
    row = suffix_dedup.dedup_substrings(df, width=400, carry=("so.urce",)).first()
    assert row["so.urce"] == "s" and bytes(row["kept"]) == b"" and row["spans"] == [(0, 600)]


def test_long_texts_are_cut_for_the_anchor_search(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 100, 5000).astype(np.uint8)
    whole = suffix_dedup.pieces(data, np.array([0, len(data)]), 40)
    monkeypatch.setattr(suffix_dedup, "LONGEST", 700)
    found = set()
    for part, offs, text, base in suffix_dedup._cut(data, np.array([0, len(data)]), 40):
        at, lo, n, off, anchor, _, _ = suffix_dedup.pieces(part, offs, 40)
        for s, length, o, a in zip(lo + base[at], n, off, anchor):
            found |= {(s + k, s + o, a) for k in range(length - 39)}
    want = {(s + k, s + o, a) for _, s, length, o, a, _, _ in zip(*whole) for k in range(length - 39)}
    assert found == want


@pytest.mark.parametrize("cells", [1 << 22, 64])
def test_lines(spark, monkeypatch, cells):
    monkeypatch.setattr(lines, "CELLS", cells)
    rnd = random.Random(4)
    shared = ["Page 12 of the report was printed here", "All rights reserved by nobody at all", "x y", "one", "a b c d e f g h"]
    texts = {}
    for i in range(40):
        body = []
        for _ in range(rnd.randrange(0, 8)):
            line = rnd.choice(shared + [" ".join(word(rnd) for _ in range(rnd.randrange(0, 9)))])
            body.append(re.sub(r"\d+", lambda _: str(rnd.randrange(99)), line) if rnd.random() < .8 else line.replace("here", word(rnd)))
        texts[i] = "\n".join(body)
    texts |= {40: None, 41: "", 42: "\n\n", 43: "\n".join(shared * 3), 44: "a b c d e f g h " * 5000}
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, leaf int, gone string")
    got = {r.doc_id: r for r in lines.drop_lines(df, min_docs=3).collect()}
    hashed = lambda tk: lines.parse_lines(*_bytes(tk), lines.LEAD)[5].view(np.int64)[0]
    want = kept_lines(texts, lines.tokens_of, hashed, lines.LEAD, lines.MIN_TOKENS, 3, lines.SIMILAR)
    if cells > 64:
        assert {i: r.text for i, r in got.items()} == want
    for i, r in got.items():
        assert r.n_lines == len((texts[i] or "").split("\n")) and r.n_dropped == r.n_lines - (len(r.text.split("\n")) if r.n_lines > r.n_dropped else 0)
    assert lines.drop_lines(df.limit(0)).collect() == []


@pytest.mark.parametrize("cells", [1 << 22, 300, 40])
def test_a_large_leaf_has_the_clusters_of_a_small_one(spark, monkeypatch, cells):
    """Templates that recur with different wording in few documents more than ``min_docs``."""
    monkeypatch.setattr(lines, "CELLS", cells)
    rnd = random.Random(8)
    bases = [["at", "a", "b", "c"] + [rnd.choice("uvwxyz") for _ in range(8)] for _ in range(4)]
    texts = {}
    for i in range(30):
        body = []
        for base in rnd.sample(bases, 2):
            w = list(base)
            for _ in range(rnd.randrange(5)):
                w[rnd.randrange(4, 12)] = rnd.choice("uvwxyz")
            body.append(" ".join(w))
        texts[i] = "\n".join(body + ["own text here " + word(rnd)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    hashed = lambda tk: lines.parse_lines(*_bytes(tk), lines.LEAD)[5].view(np.int64)[0]
    want = kept_lines(texts, lines.tokens_of, hashed, lines.LEAD, lines.MIN_TOKENS, 10, lines.SIMILAR)
    assert sum(w != texts[i] for i, w in want.items()) > 10
    assert {r.doc_id: r.text for r in lines.drop_lines(df).collect()} == want
    docs = df.selectExpr("doc_id", "xxhash64(text) AS tk", "text")
    scratch = Scratch()
    _, templates = lines.find_templates(docs, scratch)
    found = sorted((r.documents, bytes(r.template)) for r in templates.collect())
    scratch.discard()
    monkeypatch.setattr(lines, "CELLS", 1 << 22)
    _, templates = lines.find_templates(docs, scratch)
    assert found == sorted((r.documents, bytes(r.template)) for r in templates.collect())
    scratch.discard()


def _bytes(tokens):
    data = np.frombuffer(b" ".join(b"0" if t == b"<*>" else t for t in tokens), np.uint8)
    return data, np.array([0, len(data)])


def test_lines_of_repeated_rows(spark):
    rows = [(i, "the same line in all of them\nown " + "z" * (i or 0) + " text here") for i in [1, 1, 2, 3, None]]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = sorted(((r.doc_id, r.n_dropped, r.source) for r in lines.drop_lines(df, min_docs=4, carry=("source",)).collect()), key=repr)
    assert got == sorted([(1, 0, "s"), (1, 0, "s"), (2, 1, "s"), (3, 1, "s"), (None, 1, "s")], key=repr)


def test_remaining_text(spark):
    rows = [(1, "é" + "x" * 50 + "end"), (2, "start" + "x" * 50 + "è"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_dedup.digest(suffix_dedup.dedup_substrings(df, width=50), text=True)
    assert {r.doc_id: r.text for r in out.collect()} == {1: "éend", 2: "startè", 3: ""}


@pytest.mark.parametrize("most", [32768, 1])
def test_two_widths(spark, most):
    """The second width is judged on the text as it came in, whatever the first removes."""
    rnd = random.Random(most)
    base = ["".join(rnd.choice("abc é") for _ in range(rnd.randrange(0, 200))) for _ in range(8)]
    texts = base + [base[1], base[2][:60] + "XY" + base[3][20:], base[4][:15] + base[5][9:30], None, "", "a" * 70, base[6][:39]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[3]), (3, "other " * 9), (None, base[6]), (None, "null id " * 3)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, of int, lo0 string")
    for width, also in ((40, 12), (12, 40)):
        out = suffix_dedup.dedup_substrings(df, width=width, most=most, also=also)
        got = suffix_dedup.digest(out).collect()
        first, second = (substring_digest([t for _, t in rows], w) for w in (width, also))
        assert sorted(map(tuple, got), key=repr) == sorted(((i, *w) for (i, _), w in zip(rows, first)), key=repr)
        got = out.selectExpr("doc_id", f"sha2(kept_{also}, 256)").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(((i, w[3]) for (i, _), w in zip(rows, second)), key=repr)


def test_op4_and_passages_below_400_bytes(spark, tmp_path):
    """``op4``'s digests stay those of 400 bytes; its further text loses shared passages of 51 words."""
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randrange(4, 7))) for _ in range(n))
    short, long = words(51), words(90)
    assert 240 <= len(short) < 400 <= len(long)
    rows = [(1, f"{words(80)} {short} {words(30)}"), (2, f"é {short} {words(60)}"), (3, f"{words(70)} {long}"), (4, f"{long} {words(9)}"),
            (5, words(150)), (6, words(5)), (7, None), (None, f"{words(40)} {words(30)}")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    texts = [t for _, t in rows]
    for (i, text), want, shorter in zip(rows, substring_digest(texts, 400), substring_digest(texts, 240)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
        assert hashlib.sha256(got[i].text_240.encode()).hexdigest() == shorter[3]
        gone = {1: short, 2: short, 3: long, 4: long}.get(i)
        if gone:
            assert (gone in got[i].text) == (gone is short) and not set(gone.split()) & set(got[i].text_240.split())
        else:
            assert got[i].text == got[i].text_240 == (text or "")


def thue_morse(n, zero, one):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(zero, one)[b] for b in bits], [(one, zero)[b] for b in bits]


def test_hashes_of_thue_morse_words_and_lines():
    """What cancels in a polynomial modulo 2^64 does not here: words of op6, lines of op7."""
    for n in (1024, 2048, 4096):
        a, b = ("".join(x) for x in thue_morse(n, "a", "b"))
        data = np.frombuffer(f"{a} one two three {b} one two three".encode(), np.uint8)
        h, _ = minhash.words(data, np.array([0, len(data)]))
        assert len(set(h.tolist())) == 5
        a, b = (" ".join(x) for x in thue_morse(n, "left", "right"))
        data = np.frombuffer(f"{a}\n{b}\n{a}".encode(), np.uint8)
        *_, leaf, whole = lines.parse_lines(data, np.array([0, len(data)]), 4)
        assert whole[0] != whole[1] and whole[0] == whole[2] and leaf[0] == leaf[2]


def test_span_hashes_of_long_spans():
    rng = np.random.default_rng(1)
    for symbols in (rng.integers(0, 256, 6000).astype(np.uint8), rng.integers(0, 600, 6000).astype(np.uint16)):
        twice = np.concatenate([symbols, symbols[:1], symbols])
        for n in (0, 1, 7, 8, 9, 511, 512, 513, 1023, 1024, 1025, 2048, 5000):
            at = np.array([3, 6004])
            one, two = span_hashes(twice, at, at + n)
            assert one == two
            view, w = lane_view(twice), twice.itemsize
            assert same_bytes(view, at[:1] * w, view, at[1:] * w, np.array([n * w]))[0]
            if n:
                other = twice.copy()
                other[3 + n - 1] ^= 1
                one, two = span_hashes(other, at, at + n)
                assert one != two
                assert not same_bytes(lane_view(other), at[:1] * w, view, at[1:] * w, np.array([n * w]))[0]
