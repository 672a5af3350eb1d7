"""An FM-index over the words of a shard: suffixes sorted once, then searched through wavelet-tree ranks alone."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Every so many words of a text, a suffix keeps its position; a walk to the next one is shorter.
SAMPLE = 16


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


def _sorted_places(keys: np.ndarray, key_bits: int) -> np.ndarray:
    """The places of ``keys`` in their order, ties by place."""
    n = len(keys)
    if key_bits + _bits(n) > 64:
        return np.argsort(keys, kind="stable")
    low = np.uint64(_bits(n))
    both = np.sort((keys << low) | np.arange(n, dtype=np.uint64))
    return (both & np.uint64((1 << int(low)) - 1)).astype(np.int64)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order, by prefix doubling of those that are not told apart yet.

    Symbol 0 ends a text. Ends count as different, in their order, so no comparison crosses one.
    """
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    value = symbols.astype(np.uint64) + np.uint64(max(n_ends, 1) - 1)
    value[ends] = np.arange(n_ends, dtype=np.uint64)
    width = _bits(int(value.max()))
    step = max(1, min(63 - _bits(n), 40) // width)
    keys, padded = value.copy(), np.concatenate((value, np.zeros(step, np.uint64)))
    for k in range(1, step):
        keys = (keys << np.uint64(width)) | padded[k : k + n]
    order = _sorted_places(keys, width * step)
    head = np.ones(n, bool)
    keys = keys[order]
    np.not_equal(keys[1:], keys[:-1], out=head[1:])
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(head)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    open_ = np.flatnonzero(~head | ~np.append(head[1:], True))
    digits = np.uint64(_bits(n))
    while len(open_):
        at = order[open_]
        group = rank[at].astype(np.uint64)
        keys = (group << digits) | rank[at + step].astype(np.uint64)
        moved = _sorted_places(keys, 2 * int(digits))
        at, keys = at[moved], keys[moved]
        order[open_] = at
        head = np.ones(len(at), bool)
        np.not_equal(keys[1:], keys[:-1], out=head[1:])
        first = np.flatnonzero(head)
        rank[at] = np.repeat(open_[first], np.diff(np.append(first, len(at))))
        open_ = open_[~head | ~np.append(head[1:], True)]
        step *= 2
    return order


class BitRanks:
    """Bits with the count of ones before each 64 of them."""

    def __init__(self, words: np.ndarray, n: int) -> None:
        self.words, self.n = words, n
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitRanks:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        return cls(words, len(bits))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Counts and finds word sequences in texts without the texts: the last column of their sorted suffixes in a wavelet tree.

    The tree's levels are stored as one array of bits each, a level's zeros before its ones; the words before each suffix are
    read back from it. Positions are kept for every ``SAMPLE``-th word of a text, counted from its start.
    """

    def __init__(self, vocabulary: np.ndarray, symbol_of: np.ndarray, ends: np.ndarray, levels: list[BitRanks], marked: BitRanks, sampled: np.ndarray, starts_of: np.ndarray) -> None:
        self.vocabulary, self.symbol_of, self.ends = vocabulary, symbol_of, ends
        self.levels, self.marked, self.sampled, self.smaller = levels, marked, sampled, starts_of

    @classmethod
    def build(cls, words: np.ndarray, bounds: np.ndarray) -> FMIndex:
        """The index of texts given as hashes of their words, one text after the other."""
        n_texts, n_words = len(bounds) - 1, len(words)
        codes, found = pd.factorize(words)
        by_hash = np.argsort(found)
        ends = bounds[1:] + np.arange(n_texts)  # where texts end once each has an end symbol
        symbols = np.zeros(n_words + n_texts, np.int64)
        text = np.ones(len(symbols), bool)
        text[ends] = False
        symbols[text] = codes + 1
        order = suffix_order(symbols)
        n = len(symbols)
        column = symbols[order - 1].astype(np.uint32)  # the symbol before each suffix; the first wraps round to an end
        levels = []
        for level in range(_bits(len(found)) - 1, -1, -1):
            one = (column & np.uint32(1 << level)) != 0
            levels.append(BitRanks.of(one))
            column = np.concatenate((column[~one], column[one]))
        begins = np.concatenate(([0], ends[:-1] + 1)) if n_texts else np.zeros(0, np.int64)
        place = np.arange(n) - np.repeat(begins, np.diff(bounds) + 1)
        keep = (place % SAMPLE == 0)[order]
        smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=len(found) + 1))))
        return cls(found[by_hash], by_hash + 1, ends, levels, BitRanks.of(keep), order[keep], smaller)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbol of each hash, 0 for one that stands in no text."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, self.symbol_of[at], 0)

    def ranks(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the last column."""
        first = np.zeros(len(at), np.int64)
        at = at.copy()
        for k, level in enumerate(self.levels):
            one = (symbols >> (len(self.levels) - 1 - k)) & 1 == 1
            zeros = level.n - level.ones
            a, f = level.rank(at), level.rank(first)
            at = np.where(one, zeros + a, at - a)
            first = np.where(one, zeros + f, first - f)
        return at - first

    def before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol before each suffix, and how often it stands above it in the last column."""
        symbols, first, at = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at.copy()
        for level in self.levels:
            one = level.get(at) == 1
            zeros = level.n - level.ones
            a, f = level.rank(at), level.rank(first)
            at = np.where(one, zeros + a, at - a)
            first = np.where(one, zeros + f, first - f)
            symbols = 2 * symbols + one
        return symbols, at - first

    def search(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases at once, each given as its first place and its size in an array of word hashes.

        Returns the phrases that occur and the bounds of their suffixes.
        """
        symbols = self.symbols(words)
        live = np.flatnonzero(sizes > 0)
        low = high = np.zeros(len(live), np.int64)
        for k in range(int(sizes.max(initial=0))):
            more = sizes[live] > k
            here = symbols[starts[live] + np.maximum(sizes[live] - 1 - k, 0)]
            go = ~more | (here > 0)
            live, low, high, here, more = live[go], low[go], high[go], here[go], more[go]
            if k == 0:
                low, high = self.smaller[here], self.smaller[here + 1]
            elif more.any():
                s = here[more]
                both = self.ranks(np.concatenate((s, s)), np.concatenate((low[more], high[more])))
                low[more], high[more] = self.smaller[s] + both[: len(s)], self.smaller[s] + both[len(s) :]
            some = high > low
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and word position of suffixes: each walks back to the nearest sampled one of its text."""
        at, walked = rows.copy(), np.zeros(len(rows), np.int64)
        where = np.empty(len(rows), np.int64)
        going = np.arange(len(rows))
        while len(going):
            there = self.marked.get(at[going]) == 1
            done = going[there]
            where[done] = self.sampled[self.marked.rank(at[done])] + walked[done]
            going = going[~there]
            symbols, k = self.before(at[going])
            at[going] = self.smaller[symbols] + k
            walked[going] += 1
        text = np.searchsorted(self.ends, where)
        begins = np.concatenate(([0], self.ends[:-1] + 1)) if len(self.ends) else np.zeros(0, np.int64)
        return text, where - begins[text] if len(where) else where
