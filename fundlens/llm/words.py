"""Vectorised pre-tokenisation for the word-level BPE vocabulary.

The vocabulary's rules: NFC, white space runs to one space, lower case; then
words are contractions (``'s 't 're 've 'm 'll 'd``), runs of letters, single
number characters and runs of other characters; white space is dropped.

Texts whose characters are all below U+0250 are split with numpy on the code
points of many texts at once; for these, NFC changes nothing and lower case is
one character for one (U+0130 excepted). Other texts, and those that hold a
special token's string, are split one by one with the same rules.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
import regex

from fundlens.llm.common import lanes, ragged, same_bytes, span_hashes

#: Contractions of the vocabulary's split pattern: fixed values.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_SPLIT = regex.compile("|".join(CONTRACTIONS) + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_BLANK = regex.compile(r"\s+")

LIMIT = 0x250
SPACE, LETTER, NUMBER, OTHER, UNSAFE = range(5)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind, low = np.full(LIMIT, OTHER, np.uint8), np.arange(LIMIT, dtype=np.uint16)
    for cp in range(LIMIT):
        small = chr(cp).lower()
        if len(small) != 1 or ord(small) >= LIMIT:
            kind[cp] = UNSAFE
            continue
        low[cp] = ord(small)
        category = unicodedata.category(small)
        if cp in (0x20, 0x85, 0xA0) or 9 <= cp <= 13:
            kind[cp] = SPACE
        elif category[0] == "L":
            kind[cp] = LETTER
        elif category[0] == "N":
            kind[cp] = NUMBER
    return kind, low


_KIND, _LOW = _tables()


def split_text(text: str) -> list[str]:
    """Words of one text by the rules themselves."""
    text = _BLANK.sub(" ", unicodedata.normalize("NFC", text))
    return _SPLIT.findall("".join(ch.lower() for ch in text))


def split_safe(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased symbols and word spans of texts below U+0250; ``offs`` are
    the texts' offsets in code points."""
    n = len(cps)
    low, kind = _LOW[cps], _KIND[cps]
    bound = np.empty(n + 1, bool)
    bound[0] = bound[n] = True
    bound[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    bound[offs] = True
    # a lone apostrophe takes the letters of a contraction with it
    quote = np.flatnonzero((low == ord("'")) & bound[:n] & bound[1:])
    if len(quote):
        stop = offs[np.searchsorted(offs, quote, "right")]           # end of the text
        at = lambda k: np.where(quote + k < stop, low[np.minimum(quote + k, n - 1)], 0)
        one, two = at(1), at(2)
        taken = np.zeros(len(quote), np.int64)
        for word in CONTRACTIONS:
            hit = one == ord(word[1])
            if len(word) == 3:
                hit &= two == ord(word[2])
            taken[hit] = len(word) - 1
        quote, stop, taken = quote[taken > 0], stop[taken > 0], taken[taken > 0]
        bound[quote + 1] = False
        bound[quote + 1 + taken] = True
    edges = np.flatnonzero(bound)
    starts, ends = edges[:-1], edges[1:]
    word = kind[starts] != SPACE
    return low, starts[word], ends[word]


class Numbers:
    """Numbers from 0 on for distinct 64-bit hashes, looked up and added many
    at a time (open addressing, at most half full)."""

    def __init__(self, keys: np.ndarray | None = None):
        self.keys = np.zeros(1 << 14, np.uint64)                         # in the order of their numbers
        self.used = 0
        self._empty(1 << 15)
        if keys is not None:
            self.add(keys)

    def __len__(self) -> int:
        return self.used

    def _empty(self, size: int):
        self.key, self.number, self.mask = np.zeros(size, np.uint64), np.full(size, -1, np.int32), np.uint64(size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        live, place = np.arange(len(keys)), keys & self.mask
        while len(live):
            number, same = self.number[place], self.key[place] == keys
            taken = number >= 0
            hit = np.flatnonzero(taken & same)
            out[live[hit]] = number[hit]
            on = np.flatnonzero(taken & ~same)
            live, keys, place = live[on], keys[on], (place[on] + np.uint64(1)) & self.mask
        return out

    def _put(self, keys: np.ndarray, number: np.ndarray):
        place = keys & self.mask
        while len(keys):
            free = self.number[place] < 0
            self.number[place[free]] = number[free]
            on = self.number[place] != number                            # taken before, or by another of these keys
            self.key[place[~on]] = keys[~on]
            keys, number, place = keys[on], number[on], (place[on] + np.uint64(1)) & self.mask

    def add(self, keys: np.ndarray):
        """Number distinct ``keys``, none of which has a number."""
        first, self.used = self.used, self.used + len(keys)
        if self.used > len(self.keys):
            self.keys = np.concatenate([self.keys[:first], np.zeros(max(self.used, 2 * len(self.keys)) - first, np.uint64)])
        self.keys[first:self.used] = keys
        if 2 * self.used > len(self.key):
            self._empty(1 << (4 * self.used - 1).bit_length())
            first = 0
        self._put(self.keys[first:self.used], np.arange(first, self.used, dtype=np.int32))


class WordEncoder:
    """Token ids of texts through a bounded store of encoded words.

    ``encode(words)`` gives the ids of each word; it is asked once for each
    distinct word, as long as the store holds it: beyond ``most`` words those
    seen once go, and at most half stay. Words are found by hash and then
    compared; a text with a word whose hash another word has is split on its
    own. ``specials`` maps strings of special tokens to their ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], specials: dict[str, int], most: int = 250_000):
        self.encode, self.specials, self.most = encode, specials, most
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.place = Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.begin, self.count, self.hits = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0
        # the words themselves, in the order of their slots
        self.letters = np.zeros(1 << 16, np.uint16)
        self.spell, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.spelt = 0

    def _shrink(self):
        hits = self.hits[:len(self.place)]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argpartition(-hits[keep], self.most // 2)[:self.most // 2]])
        sizes = self.count[keep]
        flat = self.flat[ragged(self.begin[keep], sizes)]
        self.place = Numbers(self.place.keys[keep])
        self.used = len(flat)
        self.flat[:self.used] = flat
        self.begin[:len(keep)], self.count[:len(keep)] = np.cumsum(sizes) - sizes, sizes
        self.hits[:] = 0
        sizes = self.size[keep]
        letters = self.letters[ragged(self.spell[keep], sizes)]
        self.spelt = len(letters)
        self.letters[:self.spelt] = letters
        self.spell[:len(keep)], self.size[:len(keep)] = np.cumsum(sizes) - sizes, sizes

    def _room(self, name: str, need: int):
        have = getattr(self, name)
        if need > len(have):
            grown = np.zeros(max(need, 2 * len(have)), have.dtype)
            grown[:len(have)] = have
            setattr(self, name, grown)

    def _add(self, keys: np.ndarray, words: list[str], low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        got = self.encode(words)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        new = np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum()))
        first = len(self.place)
        spelt = ends - starts
        for name, need in (*((n, first + len(got)) for n in ("begin", "count", "hits", "spell", "size")), ("flat", self.used + len(new)),
                           ("letters", self.spelt + int(spelt.sum()))):
            self._room(name, need)
        self.spell[first:first + len(got)] = self.spelt + np.cumsum(spelt) - spelt
        self.size[first:first + len(got)] = spelt
        self.letters[self.spelt:self.spelt + int(spelt.sum())] = low[ragged(starts, spelt)]
        self.spelt += int(spelt.sum())
        self.begin[first:first + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.count[first:first + len(got)] = sizes
        self.flat[self.used:self.used + len(new)] = new
        self.used += len(new)
        self.place.add(keys)

    def _slow(self, text: str) -> np.ndarray:
        out: list[int] = []
        for part in (self.cut.split(text) if self.cut else [text]):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                for ids in self.encode(split_text(part)):
                    out += ids
        return np.array(out, np.uint32)

    def _strangers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray, at: np.ndarray) -> list[int]:
        """Texts that hold a word other than the stored one of its hash."""
        sizes = ends - starts
        same = self.size[slots] == sizes
        check = np.flatnonzero(same)
        same[check] = same_bytes(lanes(low), 2 * starts[check], lanes(self.letters[:self.spelt]), 2 * self.spell[slots[check]], 2 * sizes[check])
        return np.unique(np.searchsorted(at, starts[~same], "right") - 1).tolist()

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 texts ``data[offs[i]:offs[i+1]]``, one after
        another, and each text's offsets in them."""
        raw = data.tobytes()
        text = raw.decode("utf-8")
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(cps) == len(data):
            at = offs
        else:
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
        rough = np.flatnonzero((cps >= LIMIT) | (_KIND[np.minimum(cps, LIMIT - 1)] == UNSAFE))
        slow = set((np.searchsorted(at, rough, "right") - 1).tolist())
        for special in self.specials:
            i = text.find(special)
            while i >= 0:
                slow.add(int(np.searchsorted(at, i, "right")) - 1)
                i = text.find(special, i + 1)
        done = {}
        if slow:
            cps = cps.copy()
            for d in slow:
                done[d] = self._slow(text[at[d]:at[d + 1]])
                cps[at[d]:at[d + 1]] = 0x20
        low, starts, ends = split_safe(cps, at)
        if len(self.place) > self.most:
            self._shrink()
        hashes = span_hashes(low, starts, ends)
        slot = self.place.find(hashes)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            codes, keys = pd.factorize(hashes[missing])
            first = np.zeros(len(keys), np.int64)
            first[codes[::-1]] = missing[::-1]
            small = low.astype("<u2").tobytes().decode("utf-16-le")
            slot[missing] = len(self.place) + codes
            self._add(keys, [small[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())], low, starts[first], ends[first])
        for d in self._strangers(low, starts, ends, slot, at):
            if d not in done:
                done[d] = self._slow(text[at[d]:at[d + 1]])
        self.hits[:len(self.place)] += np.bincount(slot, minlength=len(self.place))
        sizes = self.count[slot]
        ids = self.flat[ragged(self.begin[slot], sizes)]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, at)]
        if not done:
            return ids, bounds
        parts = [done.get(d, ids[bounds[d]:bounds[d + 1]]) for d in range(len(offs) - 1)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
