"""Token counts by transducers that are compiled once and run over chunks of text.

The tokenizer is compiled into two deterministic transducers.

1. The *splitter* reads characters by class and emits a mark where a word begins. Its states
   say what the current word may still become. A chunk of text is a map from every state to
   the state after the chunk; the maps of all chunks are found side by side, one character
   position at a time, and composed by a parallel prefix scan, which yields the state at the
   start of every chunk. A second run from there emits the marks. White space needs one
   character of look-ahead, so it is read as two classes: followed by a word or not.
2. The *lexicon* reads the characters of one word. Its state is the hash of what has been
   read, and the transition that leaves a word emits the word's number of tokens. The states
   at the end of words are compiled when they are first met, by the tokenizer's own merges.

A text's count is the sum of what is emitted. Texts are joined into blocks of bounded size;
a very long text spans many chunks of its block like any other.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common

CHUNK = 64
BLOCK_CHARS = 500_000
#: Word ends kept in a worker's lexicon; it starts anew beyond that.
KEPT = 2_000_000
SPECIAL = "<|endoftext|>"

# Character classes. Contraction letters are letters that may follow an apostrophe.
LETTER, S, T, R, E, V, M, L, D, NUMBER, OTHER, QUOTE, SPACE, BLANK, LAST_SPACE, LAST_BLANK, END = range(17)
# States: which kind of word the last character belongs to. GLUE is a space that the next
# word takes along. Q is an apostrophe that began a word; QR, QV, QL one letter further.
START, WORD, NUM, SYM, WHITE, GLUE, ALONE, Q, QR, QV, QL, DONE = range(12)
_LETTERS = (LETTER, S, T, R, E, V, M, L, D)


@functools.cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """``next[state, class]`` and ``emit[state, class]``: 1 where a word begins, 2 where the
    word begins one character earlier (an apostrophe and a letter that were no contraction).
    """
    to = np.zeros((12, 17), dtype=np.uint8)
    emit = np.zeros((12, 17), dtype=np.uint8)

    def begin(c: int) -> int:
        if c in _LETTERS:
            return WORD
        return {NUMBER: NUM, OTHER: SYM, QUOTE: Q, SPACE: WHITE, BLANK: WHITE,
                LAST_SPACE: GLUE, LAST_BLANK: ALONE, END: START}[c]

    runs = {WORD: _LETTERS, NUM: (NUMBER,), SYM: (OTHER, QUOTE), WHITE: (SPACE, BLANK)}
    for c in range(17):
        for state in range(12):
            to[state, c], emit[state, c] = begin(c), 1
        for state, own in runs.items():
            if c in own:
                to[state, c], emit[state, c] = state, 0
        if c in _LETTERS + (NUMBER, OTHER, QUOTE):  # a space goes with the word after it
            to[GLUE, c], emit[GLUE, c] = (SYM if c == QUOTE else begin(c)), 0
        if c in (OTHER, QUOTE):
            to[Q, c], emit[Q, c] = SYM, 0
    for c, state in ((S, DONE), (T, DONE), (M, DONE), (D, DONE), (R, QR), (V, QV), (L, QL)):
        to[Q, c], emit[Q, c] = state, 0
    for state, c in ((QR, E), (QV, E), (QL, L)):
        to[state, c], emit[state, c] = DONE, 0
    for state in (QR, QV, QL):  # the quote was a word, its letter began the next
        for c in range(17):
            if to[state, c] != DONE or emit[state, c]:
                to[state, c] = WORD if c in _LETTERS else begin(c)
                emit[state, c] = 2 if c in _LETTERS else 3
    return to, emit


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point; white space as ``SPACE`` or ``BLANK``."""
    import regex

    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for run in regex.finditer(pattern, every):
            for a, b in _same_offset(run.start(), run.end()):
                out[a:b] = kind
    for letter, kind in zip("strevmld", range(S, D + 1)):
        out[ord(letter)] = kind
    out[ord("'")], out[ord(" ")] = QUOTE, SPACE
    return out


def _same_offset(a: int, b: int) -> list[tuple[int, int]]:
    """Positions among all characters as ranges of code points; surrogates are no characters."""
    low, gap = 0xD800, 0x800
    parts = [(a, min(b, low)), (max(a, low) + gap, b + gap)]
    return [(x, y) for x, y in parts if x < y]


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The splitter's state before every character, from ``START``, by a scan over chunks."""
    to, _ = splitter()
    flat = to.ravel()
    n = len(kinds)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, dtype=np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(12, dtype=np.uint8)[:, None], (1, chunks))
    for column in columns:
        maps = flat[maps * np.uint8(17) + column]
    # Inclusive prefix scan: after step k, maps[:, i] covers chunks i - 2^k + 1 .. i.
    step, lanes = 1, np.arange(chunks)
    while step < chunks:
        maps[:, step:] = maps[maps[:, :-step], lanes[step:]]
        step *= 2
    state = np.concatenate([[START], maps[START, :-1]]).astype(np.uint8)
    before = np.empty((CHUNK, chunks), dtype=np.uint8)
    for i, column in enumerate(columns):
        before[i] = state
        state = flat[state * np.uint8(17) + column]
    return before.T.ravel()[:n]


def word_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions where words begin in code points; ``ends`` are the positions of ``END``."""
    kinds = classes()[points]
    kinds[ends] = END
    white = (kinds == SPACE) | (kinds == BLANK)
    last = white.copy()
    last[:-1] &= ~white[1:] & (kinds[1:] != END)
    if len(last):
        last[-1] = False
    kinds[last] += LAST_SPACE - SPACE
    _, emit = splitter()
    marks = emit[states_before(kinds), kinds]
    begins = (marks & 1).astype(bool)
    begins[:-1] |= marks[1:] >= 2
    begins[ends] = False
    return np.flatnonzero(begins)


class Lexicon:
    """Emitted tokens by the state in which a word ends."""

    _MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # within a word such strings are text
        self.states = np.zeros(0, dtype=np.uint64)
        self.counts = np.zeros(0, dtype=np.int64)
        powers = np.empty(1 << 16, dtype=np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            for i in range(1, len(powers)):
                powers[i] = powers[i - 1] * self._MULTIPLIER
        self._powers = powers

    def end_states(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The state after each word: a polynomial hash of its scrambled characters."""
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        where = np.repeat(starts, lengths) + inside
        with np.errstate(over="ignore"):
            x = (points[where].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            x *= self._powers[inside & 0xFFFF] + (inside >> 16).astype(np.uint64)
            total = np.add.reduceat(x, np.cumsum(lengths) - lengths)
            total ^= total >> np.uint64(31)
            return total * np.uint64(0x94D049BB133111EB) + lengths.astype(np.uint64)

    def emitted(self, text: str, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        states = self.end_states(points, starts, lengths)
        at = np.searchsorted(self.states, states)
        found = np.zeros(len(states), dtype=bool)
        inside = at < len(self.states)
        found[inside] = self.states[at[inside]] == states[inside]
        if not found.all():
            new, first = np.unique(states[~found], return_index=True)
            words = np.flatnonzero(~found)[first]
            spelled = [text[starts[w] : starts[w] + lengths[w]] for w in words]
            done = self.library.encode_batch(spelled, add_special_tokens=False)
            if len(self.states) + len(new) > KEPT:
                self.states, self.counts = self.states[:0], self.counts[:0]
                return self.emitted(text, points, starts, lengths) if len(found) < KEPT else np.array(
                    [len(self.library.encode(text[s : s + n], add_special_tokens=False).ids)
                     for s, n in zip(starts, lengths)])
            place = np.searchsorted(self.states, new)
            self.states = np.insert(self.states, place, new)
            self.counts = np.insert(self.counts, place, [len(d.ids) for d in done])
            at = np.searchsorted(self.states, states)
        return self.counts[at]


def _lexicon(path: str) -> Lexicon:
    kept = common.worker_table("token_counts")
    if path not in kept:
        kept[path] = Lexicon(path)
    return kept[path]


def count_texts(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """The number of tokens of each text; special strings inside a text are one token each."""
    parts, owner, special = [], [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        pieces = text.split(SPECIAL) if SPECIAL in text else (text,)
        special[i] = len(pieces) - 1
        for piece in pieces:
            parts.append(piece)
            owner.append(i)
    joined = "\0".join(parts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = word_starts(points, ends)
    out = special
    if len(starts):
        part = np.searchsorted(ends, starts, side="right")
        stops = np.minimum(np.append(starts[1:], len(points)), ends[part])
        counts = lexicon.emitted(joined, points, starts, stops - starts)
        out = out + np.bincount(np.array(owner)[part], weights=counts, minlength=len(texts)).astype(np.int64)
    return out


def _blocks(batches) -> Iterator[tuple[list, list[str]]]:
    """Rows in blocks of about ``BLOCK_CHARS`` characters, at least one row each."""
    ids, texts, size = [], [], 0
    for doc_id, text in common.rows_of(batches):
        ids.append(doc_id)
        texts.append(text)
        size += len(text) + 1
        if size >= BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 512,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, in one pass without a shuffle.

    Counts are those of the tokenizers library for a byte-level vocabulary file, without
    added special tokens. A null or empty text has no bytes and no tokens. Null ids stay,
    repeated rows are counted each, other columns are left behind, an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        lexicon = _lexicon(tokenizer_path)
        for ids, texts in _blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(count_texts(texts, lexicon), pa.int64()),
                ],
                schema=schema,
            )

    counted = common.texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
