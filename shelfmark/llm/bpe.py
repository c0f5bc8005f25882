"""Ranked byte-pair merges and exact splitting of texts into words, for use inside tasks."""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import regex

# Texts of these characters alone are split alike by every Unicode version and library.
_PLAIN = re.compile("[\n\t\r\x20-\x7e\xc0-ɏ]*")
_LETTERS, _SPACES = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ", "\n\t\r\x20"
# Fixed value: public_tokenizers.PATTERN in the dialect of ``re``, equal on plain texts. The
# classes are written out and the commonest comes first, as ``re`` is quickest so.
_FAST = re.compile(
    rf"\x20?[{_LETTERS}]+|\x20?[0-9]+|'(?:[stmd]|re|ve|ll)|\x20?[^{_SPACES}0-9{_LETTERS}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def is_plain(text: str) -> bool:
    return _PLAIN.fullmatch(text) is not None


class Splitter:
    """Splits texts by the tokenizer's pattern."""

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern)

    def __call__(self, text: str) -> list[str]:
        return _FAST.findall(text) if is_plain(text) else self._any.findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge adjacent pieces, lowest rank first and leftmost among equals, to the end.

    A heap of pairs over a linked list: n log n steps, so very long words stay cheap.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the piece that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has been merged since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        if before[i] >= 0:
            rank = ranks.get(word[before[i] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Merger:
    """Merges many words at once: in every step each of them joins its lowest-ranked pair.

    Words stand in the rows of matrices by their length; words beyond the last width are
    merged one by one with ``encode_word``.
    """

    WIDTHS = (6, 9, 12, 16, 24, 48)
    _NONE = np.int32(2**31 - 1)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {
            ranks[piece[:i]] << 32 | ranks[piece[i:]]: rank
            for piece, rank in ranks.items() for i in range(1, len(piece))
            if piece[:i] in ranks and piece[i:] in ranks
        }
        self._pairs = np.array(sorted(pairs), dtype=np.int64)
        self._merged = np.array([pairs[p] for p in self._pairs.tolist()], dtype=np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of neighbours; those with an id of -1, which is none, have no rank."""
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
        known = (self._pairs[at] == pair) & (left >= 0) & (right >= 0)
        return np.where(known, self._merged[at], self._NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and how many each word has."""
        sizes = np.zeros(len(words), dtype=np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        whole = np.array([self.ranks.get(w, -1) for w in words], dtype=np.int32)
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0][:, None])]
        below = 0
        for width in self.WIDTHS:
            rows = np.flatnonzero((lengths > below) & (lengths <= width) & (whole < 0))
            if len(rows):
                done += self._merge_rows(rows, [words[r] for r in rows], lengths[rows], width)
            below = width
        for r in np.flatnonzero((lengths > below) & (whole < 0)):
            done.append((np.array([r]), np.array([encode_word(words[r], self.ranks)], dtype=np.int32)))
        for rows, ids in done:
            sizes[rows] = (ids >= 0).sum(axis=1)
        starts, flat = np.cumsum(sizes) - sizes, np.zeros(sizes.sum(), dtype=np.int32)
        for rows, ids in done:
            places = starts[rows][:, None] + np.arange(ids.shape[1])
            flat[places[ids >= 0]] = ids[ids >= 0]
        return flat, sizes

    def _merge_rows(self, rows, words, lengths, width) -> list[tuple[np.ndarray, np.ndarray]]:
        letters = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), dtype=np.uint8)
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self._bytes[letters.reshape(-1, width)], -1)
        ids = np.hstack([ids, np.full((len(ids), 1), -1)]).astype(np.int32)  # never merged
        costs = self._rank(ids[:, :-1], ids[:, 1:])
        done = []
        while len(rows):
            at = costs.argmin(axis=1)
            best = costs[np.arange(len(rows)), at]
            open_ = best < self._NONE
            if not open_.all():
                done.append((rows[~open_], ids[~open_]))
                rows, ids, costs, at, best = (x[open_] for x in (rows, ids, costs, at, best))
                if not len(rows):
                    break
            every = np.arange(len(rows))
            # The right piece of the pair leaves its row; what stands after it moves up.
            ids[every, at] = best
            moved = columns + (columns > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, moved, axis=1)
            # ... and so do the costs behind the pair.
            moved = np.minimum(columns + (columns >= at[:, None]), width - 1)
            costs = np.take_along_axis(costs, moved, axis=1)
            costs[every, at] = self._rank(best, ids[every, at + 1])
            before = np.flatnonzero(at > 0)
            costs[before, at[before] - 1] = self._rank(ids[before, at[before] - 1], best[before])
        return done
