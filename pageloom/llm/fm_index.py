"""FM-index of a sequence of symbols: suffix order, wavelet matrix, sampled places. In numpy, for what one task holds."""

from __future__ import annotations

import numpy as np

#: Every so many places of the sequence are kept; a hit walks fewer steps than this to one of them.
SAMPLE = 16


def suffix_order(seq: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of ``seq`` (numbers below ``symbols``, the last one least and alone) in order: a few symbols at once, then
    doubling, in which only groups that aren't told apart yet are sorted again."""
    n, bits = len(seq), max(1, int(symbols - 1).bit_length())
    h = max(1, 63 // bits)
    padded = np.concatenate((seq.astype(np.int64), np.zeros(h, np.int64)))
    keys = padded[:n].copy()
    for j in range(1, h):
        keys <<= bits
        keys |= padded[j : j + n]
    order = np.argsort(keys)
    head = np.ones(n + 1, bool)
    head[1:n] = keys[order[1:]] != keys[order[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head[:n], np.arange(n), 0))
    slots = np.flatnonzero(~(head[:-1] & head[1:]))
    while len(slots):
        some = order[slots]
        pair = rank[some] * (n + 1) + rank[np.minimum(some + h, n)] + 1
        by = np.argsort(pair)
        some, pair = some[by], pair[by]
        order[slots] = some
        split = np.ones(len(slots), bool)
        split[1:] = pair[1:] != pair[:-1]
        head[slots[split]] = True
        rank[some] = np.maximum.accumulate(np.where(split, slots, 0))
        slots = slots[~(head[slots] & head[slots + 1])]
        h *= 2
    return order


class BitRank:
    """Bits, and how many ones lie before a place."""

    __slots__ = ("before", "ones", "words")

    def __init__(self, words: np.ndarray):
        self.words = words
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.ones = int(counts.sum())

    @staticmethod
    def packed(bits: np.ndarray) -> np.ndarray:
        """``bits`` as words of 64, one place more than there are bits."""
        out = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        some = np.packbits(bits, bitorder="little")
        out[: len(some)] = some
        return out.view(np.uint64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Backward search and location. ``parts`` are its arrays by name, to be stored as bytes and read back."""

    def __init__(self, levels: np.ndarray, counts: np.ndarray, marks: np.ndarray, places: np.ndarray):
        self.parts = {"levels": levels, "counts": counts, "marks": marks, "places": places}
        self.levels = [BitRank(words) for words in levels]
        self.n = int(counts.sum())
        self.zeros = [self.n - level.ones for level in self.levels]
        self.marks, self.places = BitRank(marks), places
        # Where symbol c begins among the sorted suffixes, less where the wavelet matrix puts its occurrences.
        depth, number = len(levels), np.arange(len(counts))
        turned = np.zeros(len(counts), np.int64)
        for bit in range(depth):
            turned |= ((number >> bit) & 1) << (depth - 1 - bit)
        by = np.argsort(turned)
        ends = np.zeros(len(counts), np.int64)
        ends[by] = np.cumsum(counts[by]) - counts[by]
        self.shift = np.cumsum(counts) - counts - ends

    @classmethod
    def built(cls, seq: np.ndarray, symbols: int, kept: np.ndarray, sample: int = SAMPLE) -> FMIndex:
        """Of ``seq``, whose last symbol is 0 and alone; places in ``kept`` are kept besides every ``sample``-th."""
        order = suffix_order(seq, symbols)
        last = seq[order - 1]  # the symbol before each suffix; before the first one, the last
        depth, levels = max(1, int(symbols - 1).bit_length()), []
        for bit in range(depth - 1, -1, -1):
            ones = (last >> bit) & 1 != 0
            levels.append(BitRank.packed(ones))
            last = np.concatenate((last[~ones], last[ones]))
        wanted = np.arange(len(seq)) % sample == 0
        wanted[kept] = True
        marked = wanted[order]
        return cls(np.array(levels), np.bincount(seq, minlength=symbols).astype(np.int64), BitRank.packed(marked), order[marked].astype(np.int32))

    def _followed(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of suffixes before ``at``, those that ``symbol`` stands before, as a place among the suffixes it begins."""
        for i, level in enumerate(self.levels):
            ones = level.rank(at)
            at = np.where((symbol >> (len(self.levels) - 1 - i)) & 1 != 0, self.zeros[i] + ones, at - ones)
        return at + self.shift[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of the suffixes that begin with each row of ``phrases``, of which the first ``lengths`` symbols count."""
        low, high = np.zeros(len(phrases), np.int64), np.where(lengths > 0, self.n, 0)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step]
            both = self._followed(np.concatenate((symbol, symbol)), np.concatenate((low[live], high[live])))
            low[live], high[live] = both[: len(live)], both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the sequence the suffixes of ``rows`` begin: each steps back until it meets a place that is kept."""
        out, steps = np.empty(len(rows), np.int64), 0
        live, at = np.arange(len(rows)), rows
        while len(live):
            known = self.marks.get(at)
            out[live[known]] = self.places[self.marks.rank(at[known])] + steps
            live, at = live[~known], at[~known]
            symbol = np.zeros(len(at), np.int64)
            for i, level in enumerate(self.levels):
                ones, one = level.rank(at), level.get(at)
                symbol = symbol << 1 | one
                at = np.where(one, self.zeros[i] + ones, at - ones)
            at = at + self.shift[symbol]
            steps += 1
        return out
