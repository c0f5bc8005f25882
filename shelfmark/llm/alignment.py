"""Cross-tokenizer alignment: two tokenizations of a text merged in lockstep.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback. A
batch's token ends are byte offsets in one row of numbers each. Lanes are documents, long ones
in slices of ``LANE_BYTES`` (pointers of a slice are found by bisection, as ends only rise).
One vector of A pointers and one of B pointers advance all lanes at once: in every step the
token that ends first gives way, equal ends are a cut and a link, and lanes that are finished
are dropped.

How often a pair of ids is linked is counted over the whole corpus. The two tokens of a link
end together, so one's bytes end in the other's; all such pairs follow from the vocabularies,
and there are fewer of them than the vocabularies have bytes. This bounds what tasks need to
know of the corpus.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bpe, common
from shelfmark.llm.word_tokens import byte_letters
from shelfmark.session import materialize

#: Characters of text in a batch, and bytes of a lane.
BATCH_CHARS, LANE_BYTES = 2 * 2**20, 1024
#: Words that a worker remembers for each tokenizer, and the longest of them; others are
#: encoded anew.
KEPT, KEPT_CHARS = 400_000, 48
_SPACE = "▁"
_BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")

# --- tokenizers --------------------------------------------------------------------------------


class _Words:
    """Ids of texts, put together from those of words whose tokens do not depend on neighbours.

    Ids are packed as 32-bit numbers; None marks a word whose tokens do not spell it.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.known: dict[str, bytes | None] = {}

    def split(self, text: str) -> list[str] | None:
        """The words of a blank and the text; None if it has to be encoded as a whole."""
        raise NotImplementedError

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def encode_text(self, text: str) -> list[int]:
        """The ids of a blank and the text."""
        raise NotImplementedError

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of a blank and each text, or None if these are not their bytes."""
        split = [self.split(t) for t in texts]
        known = self.known
        new = list(set().union(*[words for words in split if words]).difference(known))
        if new:
            known.update(zip(new, map(self._packed, new, self.encode_words(new))))
        out = []
        for text, words in zip(texts, split):
            try:
                if words is None:
                    joined = self._packed(f" {text}", self.encode_text(text))
                else:
                    joined = b"".join(map(known.__getitem__, words))
            except TypeError:  # a word that its tokens do not spell
                joined = None
            out.append(None if joined is None else np.frombuffer(joined, dtype="<u4"))
        for word in new:
            if len(word) > KEPT_CHARS:
                del known[word]
        while len(known) > KEPT:
            known.popitem()
        return out

    def _packed(self, word: str, ids: list[int]) -> bytes | None:
        spelled = b"".join([self.tokens[i] for i in ids])
        return array("I", ids).tobytes() if spelled == word.encode() else None


class ByteLevel(_Words):
    """Tokenizer A: a blank and the text."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings are plain text
        self.model = self.library.model
        self.splitter = bpe.Splitter(pattern)
        self.letters = byte_letters()
        of_letter = {letter: byte for byte, letter in self.letters.items()}
        tokens = []
        for i in range(self.library.get_vocab_size()):
            token = self.library.id_to_token(i) or ""
            known = all(c in of_letter for c in token)
            tokens.append(bytes(of_letter[c] for c in token) if known else token.encode())
        super().__init__(tokens)

    def split(self, text: str) -> list[str] | None:
        # Other characters are left to the library, which may know another version of Unicode.
        return self.splitter(f" {text}") if bpe.is_plain(text) else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        spelled = [w.encode().decode("latin-1").translate(self.letters) for w in words]
        return [[token.id for token in self.model.tokenize(w)] for w in spelled]

    def encode_text(self, text: str) -> list[int]:
        return self.library.encode(f" {text}", add_special_tokens=False).ids


class Pieces(_Words):
    """Tokenizer B, which adds the blank before a text.

    Words are runs of letters or of other characters, with the blanks before them. A merge that
    leaves a word makes a piece that is more than one; texts that have such a piece in them are
    encoded as a whole.
    """

    _WORD = re.compile(r" *(?:[^\W\d_]+|(?:[^\w ]|[\d_])+)| +")

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        super().__init__([_piece_bytes(self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())])
        no_text = {i for i in range(len(self.tokens)) if self.library.is_control(i) or self.library.is_unknown(i)}
        pieces = [t.decode() for i, t in enumerate(self.tokens) if i not in no_text and _is_text(t)]
        self.across = [p for p in pieces if len(self._WORD.findall(p)) != 1]
        self.blank = self.library.piece_to_id(_SPACE)
        # What a word without a blank is encoded after: it ends in a character of the other kind.
        self.before = {kind: (text, len(self.library.encode(text))) for kind, text in ((True, "."), (False, "a"))}

    def split(self, text: str) -> list[str] | None:
        whole = f" {text}"
        return None if any(p in whole for p in self.across) else self._WORD.findall(whole)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        spelled, skipped = [], []
        for word in words:
            # The library writes a blank before what it is given.
            before, skip = ("", 0) if word[0] == " " else self.before[_LETTER.match(word) is not None]
            spelled.append(before + word if before else word[1:])
            skipped.append(skip)
        found = self.library.encode(spelled, num_threads=1)
        return [ids[skip:] if ids else [self.blank] for ids, skip in zip(found, skipped)]

    def encode_text(self, text: str) -> list[int]:
        return self.library.encode(text)


_LETTER = re.compile(r"[^\W\d_]")


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


def _piece_bytes(piece: str) -> bytes:
    byte = _BYTE_PIECE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode()


class Pairs:
    """All pairs of ids that can be linked, numbered: the bytes of one end in the other's."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        by_bytes: tuple[dict, dict] = defaultdict(list), defaultdict(list)
        for tokens, found in zip((a, b), by_bytes):
            for i, token in enumerate(tokens):
                found[token].append(i)
        keys = set()
        for i, token in enumerate(a):
            for at in range(len(token)):
                keys.update([i * len(b) + j for j in by_bytes[1].get(token[at:], ())])
        for j, token in enumerate(b):
            for at in range(1, len(token)):
                keys.update([i * len(b) + j for i in by_bytes[0].get(token[at:], ())])
        self.width = len(b)
        self.keys = np.array(sorted(keys), dtype=np.int64)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b)

    def best(self, counts: np.ndarray) -> np.ndarray:
        """Which pairs have the highest count of their B id."""
        b = self.keys % self.width
        highest = np.zeros(self.width, dtype=np.int64)
        np.maximum.at(highest, b, counts)
        return counts == highest[b]


class Aligner:
    def __init__(self, a_path: str, b_path: str, pattern: str):
        self.a, self.b = ByteLevel(a_path, pattern), Pieces(b_path)
        self.pairs = Pairs(self.a.tokens, self.b.tokens)
        self.digits = [_digits(len(t.tokens)) for t in (self.a, self.b)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of each text, none if the bytes of either are not the text's."""
        some = [t for t in texts if t]
        found = zip(self.a.ids(some), self.b.ids(some))
        both = ((a, b) if a is not None and b is not None else (_NONE, _NONE) for a, b in found)
        return [next(both) if t else (_NONE, _NONE) for t in texts]


_NONE = np.zeros(0, dtype="<u4")

# --- merging -----------------------------------------------------------------------------------


def merge_lockstep(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a_ends`` and ``b_ends`` of equal ends, in order.

    ``bounds`` has where each document ends, after a leading 0.
    """
    slices = -(-np.diff(bounds) // LANE_BYTES)
    inside = np.arange(slices.sum()) - np.repeat(np.cumsum(slices) - slices, slices)
    starts = np.repeat(bounds[:-1], slices) + inside * LANE_BYTES
    stops = np.minimum(starts + LANE_BYTES, np.repeat(bounds[1:], slices))
    pointers = [np.searchsorted(ends, starts, side="right") for ends in (a_ends, b_ends)]
    limits = [np.searchsorted(ends, stops, side="right") for ends in (a_ends, b_ends)]
    (i, j), (i_stop, j_stop) = pointers, limits
    links: list[tuple[np.ndarray, np.ndarray]] = [(i[:0], j[:0])]
    while True:
        going = (i < i_stop) & (j < j_stop)
        if not going.all():
            i, j, i_stop, j_stop = (x[going] for x in (i, j, i_stop, j_stop))
        if not len(i):
            break
        a, b = a_ends[i], b_ends[j]
        equal = a == b
        links.append((i[equal], j[equal]))
        i, j = i + (a <= b), j + (b <= a)
    # Links are in order on both sides.
    return np.sort(np.concatenate([x for x, _ in links])), np.sort(np.concatenate([y for _, y in links]))


def _digits(n: int) -> np.ndarray:
    """The decimal digits of numbers below ``n`` as rows of characters, 0 after the last."""
    width = len(str(max(n - 1, 0)))
    return np.array([list(str(i).encode().ljust(width, b"\0")) for i in range(n)], dtype=np.uint8)


def spell_groups(
    aligner: Aligner, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, last_cut: np.ndarray
) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document; ``last_cut`` is the number of cuts up to its end."""
    a_of, b_of = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    a_of[a_cut], b_of[b_cut] = 1, 1
    a_of, b_of = np.cumsum(a_of) - a_of, np.cumsum(b_of) - b_of  # the group of each token
    a_at = np.arange(len(a)) + np.concatenate([[0], b_cut + 1])[a_of]
    b_at = np.arange(len(b)) + (a_cut + 1)[b_of]
    width = max(d.shape[1] for d in aligner.digits)
    chars = np.zeros((len(a) + len(b), width + 1), dtype=np.uint8)
    for ids, at, cut, digits, mark in zip((a, b), (a_at, b_at), (a_cut, b_cut), aligner.digits, b"|;"):
        chars[at, : digits.shape[1]] = digits[ids]
        ends = np.full(len(ids), ord(","), dtype=np.uint8)
        ends[cut] = mark
        chars[at, width] = ends
    used = chars != 0
    stops = np.cumsum(used.sum(axis=1))
    flat = chars[used].tobytes()
    cuts = b_at[b_cut]
    out, begin, before = [], 0, 0
    for last in last_cut.tolist():
        end = int(stops[cuts[last - 1]]) if last > before else begin
        out.append(flat[begin : end - 1] if end > begin else b"")
        begin, before = end, last
    return out


def align_texts(aligner: Aligner, texts: list[str]) -> Iterator[tuple]:
    """For each text ``n_a, n_b, n_groups, groups, pairs, times``: counts, the groups as text,
    the numbers of its linked pairs and how often each is linked."""
    both = aligner.tokens(texts)
    a, b = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) for x in both]) for k in (0, 1))
    a_ends, b_ends = np.cumsum(aligner.a.sizes[a]), np.cumsum(aligner.b.sizes[b])
    a_last = np.cumsum(n_a)
    bounds = np.concatenate([[0], a_ends])[np.concatenate([[0], a_last])]
    a_cut, b_cut = merge_lockstep(a_ends, b_ends, bounds)
    last_cut = np.searchsorted(a_cut, a_last)
    n_cuts = np.diff(last_cut, prepend=0)
    groups = spell_groups(aligner, a, b, a_cut, b_cut, last_cut)
    pairs = aligner.pairs.numbers(a[a_cut], b[b_cut])
    size = len(aligner.pairs.keys)
    keys, times = np.unique(np.repeat(np.arange(len(texts)), n_cuts) * size + pairs, return_counts=True)
    at = np.searchsorted(keys, np.arange(len(texts) + 1) * size)
    for k, (low, high) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        yield int(n_a[k]), int(n_b[k]), int(n_cuts[k]), groups[k], keys[low:high] - k * size, times[low:high]


# --- the job -----------------------------------------------------------------------------------

_ALIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
     ("groups", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
)
_ALIGNED_SPARK = (
    "doc_id long, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"
)


def _aligner(*paths: str) -> Aligner:
    kept = common.worker_table("alignment")
    if paths not in kept:
        kept[paths] = Aligner(*paths)
    return kept[paths]


def _batches(rows: Iterator[tuple]) -> Iterator[tuple[list, list[str]]]:
    """Rows in batches of about ``BATCH_CHARS`` characters, at least one row each."""
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text)
        size += len(text) + 1
        if size >= BATCH_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _list_column(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])])
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))


def _digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest() if groups else ""


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, pattern: str, digest: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row.

    ``groups`` writes the ids between two places where tokens of both end, A's before B's:
    ``a1,a2|b1;a3|b2,b3``; with ``digest`` it is the SHA-256 of that, for groups are several
    times as long as the text. ``n_links`` counts token pairs that end together; a link's count
    is how often its pair of ids is linked in all rows. ``n_best`` counts the links whose count
    is the highest of their B id, ``count_sum`` adds the counts up. Null and empty texts, and
    those that either tokenizer does not spell byte by byte, have zeros and no groups. Null ids
    stay, repeated rows count each, other columns are left behind, an empty table gives no rows.

    ``pattern`` is A's split pattern. No token may be empty, as in any such vocabulary, so there is one
    link for each group.
    """
    spark = docs.sparkSession

    def run(batches):
        aligner = _aligner(a_path, b_path, pattern)
        for ids, texts in _batches(common.rows_of(batches)):
            n_a, n_b, n_groups, groups, pairs, times = zip(*align_texts(aligner, texts))
            spelled = [_digest(g) if digest else g.decode() for g in groups]
            columns = [pa.array(c, pa.int64()) for c in (ids, n_a, n_b, n_groups)]
            columns += [pa.array(spelled, pa.string()), _list_column(pairs), _list_column(times)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ALIGNED)], schema=_ALIGNED)

    rows = common.texts(docs, id_col, text_col).mapInArrow(run, _ALIGNED_SPARK)
    aligned = materialize(rows, "aligned")
    linked = aligned.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs")
    # No more rows than pairs that the two vocabularies can link.
    found = linked.agg(F.sum("times").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast((found["pairs"].to_numpy(), found["n"].to_numpy()))

    def judge(batches):
        pairs = _aligner(a_path, b_path, pattern).pairs
        counts = np.zeros(len(pairs.keys), dtype=np.int64)
        counts[shared.value[0]] = shared.value[1]
        best = pairs.best(counts).astype(np.int64)
        for batch in batches:
            lists = [batch.column(c) for c in ("pairs", "times")]
            at = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))])
            number, times = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            sums = [np.concatenate([[0], np.cumsum(times * x[number])])[at] for x in (best, counts)]
            judged = [pa.array(np.diff(s), pa.int64()) for s in sums]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays(
                [*kept, batch.column("n_groups"), *judged, batch.column("groups")], _JUDGED
            )

    return aligned.mapInArrow(judge, _JUDGED_SPARK)


_JUDGED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
_JUDGED_SPARK = ", ".join(f"{c} long" for c in _JUDGED[:-1]) + ", groups string"
