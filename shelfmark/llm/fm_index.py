"""An FM-index of a shard of numbered words: search phrases, locate where they stand.

The shard is a sequence of symbols; 0 ends a run of words and no phrase contains it. All
functions take many phrases or rows at once as NumPy vectors.
"""

from __future__ import annotations

import numpy as np

#: Every so many symbols a suffix position is kept, besides those where a run begins.
SAMPLED = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix starts in order, by prefix doubling.

    Each 0 is a symbol of its own, ordered by place, so that suffixes are told apart by the end
    of their run at the latest and log2 of the longest run bounds the rounds.
    """
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, np.count_nonzero(ends) + symbols)
    reach, n = 1, len(symbols)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        steps = np.empty(n, dtype=np.int64)
        steps[:1] = 0
        np.cumsum(np.diff(key[order]) != 0, out=steps[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        if n == 0 or steps[-1] == n - 1:
            return order
        reach = min(2 * reach, n)


class WaveletTree:
    """Ranks of symbols in a sequence: one level for each bit, the highest first.

    The node of a symbol at a level begins where the symbols with smaller leading bits end.
    """

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        counts = np.bincount(sequence, minlength=1 << self.bits)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.ones = []
        level = sequence
        for depth in range(self.bits):
            bit = (level >> (self.bits - 1 - depth)) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            # The next level holds the symbols by their first depth + 1 bits, in place order.
            node = level >> (self.bits - 1 - depth)
            # Numbers of 16 bits are sorted by radix.
            level = level[np.argsort(node.astype(np.uint16) if depth < 16 else node, kind="stable")]

    def rank(self, symbol: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """How often each symbol stands before ``stop``."""
        inside = stop.copy()
        for depth, ones in enumerate(self.ones):
            start = self.before[(symbol >> (self.bits - depth)) << (self.bits - depth)]
            set_ = ones[start + inside] - ones[start]
            is_one = (symbol >> (self.bits - 1 - depth)) & 1
            inside = np.where(is_one == 1, set_, inside - set_)
        return inside


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        """``symbols`` ends in 0 if it is not empty; words are 1 to ``alphabet - 1``."""
        order = suffix_array(symbols)
        self.last = symbols[order - 1]  # the symbol before each suffix
        self.tree = WaveletTree(self.last, alphabet)
        self.first = self.tree.before  # where the suffixes that begin with a symbol begin
        kept = (order % SAMPLED == 0) | (self.last == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def _left(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (rows of one length) that occur: their numbers, and first and end row."""
        which = np.arange(len(phrases))
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), len(self.last), dtype=np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, column]
            low, high = self._left(symbol, low), self._left(symbol, high)
            found = low < high
            which, low, high = which[found], low[found], high[found]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: steps to the left up to a kept one.

        Where a run begins is always kept, so no step passes a 0.
        """
        places = np.empty(len(rows), dtype=np.int64)
        open_ = np.arange(len(rows))
        steps = 0
        while len(open_):
            here = self.kept[rows + 1] > self.kept[rows]
            places[open_[here]] = self.places[self.kept[rows[here]]] + steps
            open_, rows = open_[~here], rows[~here]
            rows = self._left(self.last[rows], rows)
            steps += 1
        return places
