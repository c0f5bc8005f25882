"""Ids of a tokenizer of lower-cased words, by a table of the words met so far."""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shelfmark.llm.common import worker_table

#: Pieces that a worker's table takes before it starts anew with those of the texts at hand.
KEPT = 150_000
# Texts that the library gets as a whole: those that are not ``bpe.is_plain``, those in which
# a special string may stand, and those with the one plain letter that lower-cases to two.
_WHOLE = "<\\||İ|[^\n\t\r\x20-\x7e\xc0-ɏ]"
# Fixed value: the tokenizer's own split pattern, for lower-cased words of plain texts.
_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with, by byte: printable ones
    stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    kept = worker_table("word_tokens")
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Encoder:
    """From texts to their ids (little-endian unsigned 32-bit), one per worker and file.

    Ids are those of the tokenizers library without added special tokens. Plain texts are
    put together from the ids of their words, and these from the ids of their pieces, for
    merges never cross the tokenizer's split, nor does that ever cross white space. Texts
    with other characters or with a special string are given to the library as a whole.

    Words and pieces stay in Arrow arrays. The table of pieces is asked once for the distinct
    pieces of many texts, and only those new to it become Python objects.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model, self._letters = self._library.model, byte_letters()
        self._known = pa.array([], pa.string())
        self._ids, self._sizes = np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)

    def __call__(self, text: str) -> np.ndarray:
        return self.many(pa.array([text], pa.string()))[0]

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text; they share memory."""
        whole = pc.match_substring_regex(texts, _WHOLE)
        plain = pc.ascii_lower(pc.if_else(whole, "", texts))
        found = _put_together(pc.ascii_split_whitespace(plain), self._of_words)
        found = np.split(found[0], np.cumsum(found[1])[:-1]) if len(texts) else []
        for at in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            made = self._library.encode(texts[at].as_py(), add_special_tokens=False)
            found[at] = np.array(made.ids, dtype="<u4")
        return found

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lower = pc.utf8_lower(words)
        mixed = pc.invert(pc.utf8_is_alpha(lower))
        cut = pc.replace_substring_regex(lower.filter(mixed), _PIECE, r"\0 ")
        spaced = pc.replace_with_mask(lower, mixed, cut)
        return _put_together(pc.ascii_split_whitespace(spaced), self._of_pieces)

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at = pc.index_in(pieces, value_set=self._known)
        new = pieces.filter(at.is_null())
        rows = at.fill_null(0).to_numpy().astype(np.int64)
        rows[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(new)) + len(self._known)
        made = [self._of_piece(p) for p in new.to_pylist()]
        self._known = pa.concat_arrays([self._known, new])
        self._ids = np.concatenate([self._ids, np.frombuffer(b"".join(made), dtype="<u4")])
        self._sizes = np.concatenate([self._sizes, np.array([len(m) // 4 for m in made], dtype=np.int64)])
        ids, sizes = _taken(self._ids, self._sizes, rows)
        if len(self._known) > KEPT:
            self._known, self._ids, self._sizes = pieces, ids, sizes
        return ids, sizes

    def _of_piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        ids = [token.id for token in self._model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)


def _put_together(lists: pa.ListArray, ids_of) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists, one after another, and how many each has.

    ``ids_of`` gives the same of the distinct values.
    """
    coded = lists.flatten().dictionary_encode()
    ids, sizes = ids_of(coded.dictionary)
    ids, sizes = _taken(ids, sizes, coded.indices.to_numpy())
    ends = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.diff(ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])])
    return ids, counts


def _taken(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some rows, of ``ids`` that hold ``sizes`` of them for each row."""
    starts, sizes = (np.cumsum(sizes) - sizes)[rows], sizes[rows]
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    places += np.arange(len(places))
    return ids[places], sizes
