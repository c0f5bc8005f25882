"""Byte-level BPE: encoding by folds of ranked merges, decoding by joining binary pieces.

Bytes are written as characters U+0000 to U+00FF, so byte arrays are arrays of one-character
strings and merging two pieces is ``concat``. The ranks are a literal of the plan: an array
of small maps, chosen by crc32 of the piece, for a lookup in a Spark map walks all its keys.

1. Words are counted over all texts (partial aggregation, one shuffle of distinct words).
2. The most frequent words, at most ``FREQUENT`` by a threshold on the count, are encoded and
   decoded by higher-order functions alone. That dictionary has a fixed bound and is
   broadcast.
3. One pass over the texts puts ids together from it. The remaining, rare words are merged
   where they occur, by the same ranks in the same order. Joining them back instead would
   shuffle a row for every token.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import bpe, common
from shelfmark.session import materialize

#: Bound of the broadcast dictionary, in words.
FREQUENT = 120_000
#: Longer words, in bytes, are not folded: the fold takes quadratic time.
FOLDED_BYTES = 48
#: Rare words remembered by a worker, and bytes of all its words; later ones are merged anew.
KEPT, KEPT_BYTES = 500_000, 128 << 20
#: Characters of texts that are put together at once.
GROUP_CHARS = 1 << 20
_NO_RANK = 2**31 - 1
_BUCKETS = 8192


def as_chars(binary: Column) -> Column:
    return F.decode(binary, "ISO-8859-1")


def as_bytes(chars: Column) -> Column:
    return F.encode(chars, "ISO-8859-1")


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as one constant: ``array<map<string,int>>``, folded by the optimizer."""
    maps: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        chars = piece.decode("latin-1")
        maps[zlib.crc32(chars.encode()) % _BUCKETS][chars] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def piece_literal(ranks: dict[bytes, int]) -> Column:
    """Pieces by id as one constant, ``array<string>``; ids without a piece are null."""
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def rank_of(literal: Column, piece: Column) -> Column:
    bucket = (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int")
    return F.coalesce(F.element_at(F.get(literal, bucket), piece), F.lit(_NO_RANK))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that the plan holds once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_merges(chars: Column, literal: Column) -> Column:
    """The pieces left when no two neighbours of a word have a rank, as ``array<string>``."""

    def merge(state: Column, _: Column) -> Column:
        pieces = state["pieces"]
        pairs = F.transform(
            F.sequence(F.lit(0), F.size(pieces) - 2),
            lambda i: F.struct(
                rank_of(literal, F.concat(F.get(pieces, i), F.get(pieces, i + 1))).alias("rank"),
                i.alias("i"),
            ),
        )

        def apply(best: Column) -> Column:
            i = best["i"]
            joined = F.concat(
                F.slice(pieces, F.lit(1), i),
                F.array(F.concat(F.get(pieces, i), F.get(pieces, i + 1))),
                F.slice(pieces, i + 3, F.size(pieces)),
            )
            more = best["rank"] < _NO_RANK
            return F.struct(
                F.when(more, joined).otherwise(pieces).alias("pieces"),
                (more & (F.size(pieces) > 2)).alias("open"),
            )

        merged = bound(F.array_min(pairs), apply)
        return F.when(state["open"], merged).otherwise(state)

    start = F.struct(F.split(chars, "").alias("pieces"), (F.length(chars) > 1).alias("open"))
    steps = F.sequence(F.lit(1), F.greatest(F.length(chars) - 1, F.lit(1)))
    folded = F.aggregate(steps, start, merge)["pieces"]
    return F.when(rank_of(literal, chars) < _NO_RANK, F.array(chars)).otherwise(folded)


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``word, ids, decoded`` of distinct words of at most ``FOLDED_BYTES`` bytes, by folds."""
    chars = as_chars(F.encode("word", "UTF-8"))
    ids = bound(
        rank_literal(ranks),
        lambda literal: F.transform(fold_merges(chars, literal), lambda p: rank_of(literal, p)),
    )
    encoded = words.select("word", ids.alias("ids"))
    return encoded.withColumn("decoded", decode_ids(F.col("ids"), piece_literal(ranks)))


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of ids: their pieces joined. An id without a piece makes the result null."""
    return as_bytes(
        bound(pieces, lambda p: F.aggregate(ids, F.lit(""), lambda joined, i: F.concat(joined, F.get(p, i))))
    )


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """``word, n`` over all texts (``doc_id, text``)."""
    unicode_pattern = "(?U)" + pattern
    words = docs.select(
        F.explode(F.regexp_extract_all("text", F.lit(unicode_pattern), F.lit(0))).alias("word")
    )
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> DataFrame:
    """At most about ``most`` words, those of the highest counts.

    Counts are told apart in steps; of the step that no longer fits, a part by hash is taken.
    """
    counts = counts.where(F.octet_length("word") <= FOLDED_BYTES)
    step = F.floor(F.log2("n") * 8).cast("int")
    found = {r["step"]: r["words"] for r in
             counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect()}
    room, lowest = most, max(found, default=0) + 1
    while found:
        largest = max(found)
        if found[largest] > room:
            break
        room -= found.pop(largest)
        lowest = largest
    chosen = step >= lowest
    if found and room:
        parts = 1 << 20
        some = F.pmod(F.xxhash64("word"), F.lit(parts)) < parts * room // found[largest]
        chosen = chosen | ((step == largest) & some)
    return counts.where(chosen).select("word")


def encode_documents(
    docs: DataFrame, ranks_path: str, pattern: str, frequent: int = FREQUENT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row.

    ``ids`` are those of the tiktoken library for the rank file and pattern, without special
    tokens, written in decimal and joined by commas; ``decoded`` is the bytes of the pieces
    of these ids. A null or empty text has no ids. Null ids of rows stay, repeated rows are
    encoded each, other columns are left behind, an empty table gives no rows.
    """
    spark = docs.sparkSession
    ranks = bpe.load_ranks(ranks_path)
    rows = common.texts(docs, id_col, text_col)
    counts = materialize(word_counts(rows, pattern), "word-counts")
    # At most `frequent` short words: repartitioned so that the folds run in parallel.
    chosen = frequent_words(counts, frequent).repartition(24, "word")
    encoded = encode_words(chosen, ranks).select(
        "word", F.concat(F.lit(","), F.array_join("ids", ",")).alias("ids"),
        F.size("ids").alias("n"), "decoded",
    )
    # Columns of a bounded number of words, in one piece.
    packed = pa.BufferOutputStream()
    with pa.ipc.new_stream(packed, (table := encoded.toArrow()).schema) as out:
        out.write_table(table)
    shared = spark.sparkContext.broadcast(packed.getvalue().to_pybytes())
    name = uuid.uuid4().hex

    def run(batches):
        words = _words(name, shared, ranks_path)
        split = bpe.Splitter(pattern)
        for docs_at_once in _groups(common.rows_of(batches)):
            yield words.encode([i for i, _ in docs_at_once], [split(t) for _, t in docs_at_once])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded binary")


def _groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows by the hundreds; long texts in smaller groups, a very long one by itself."""
    held, chars = [], 0
    for row in rows:
        if held and (chars + len(row[1]) > GROUP_CHARS or len(held) >= 500):
            yield held
            held, chars = [], 0
        held.append(row)
        chars += len(row[1])
    if held:
        yield held


class _Pieces:
    """Byte strings laid end to end, which grow and are read by Arrow without a copy."""

    def __init__(self):
        self.n, self._ends = 0, np.zeros(1 << 10, dtype=np.int32)
        self._data = np.empty(1 << 16, dtype=np.uint8)

    def bytes(self) -> int:
        return int(self._ends[self.n])

    def extend(self, values: pa.BinaryArray) -> None:
        if not len(values):
            return
        ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset :][: len(values) + 1]
        low, n = self.bytes(), self.n + len(values)
        high = low + int(ends[-1] - ends[0])
        if n >= len(self._ends):
            self._ends = np.concatenate([self._ends, np.zeros(n, dtype=np.int32)])
        if high > len(self._data):
            self._data = np.concatenate([self._data[:low], np.empty(2 * high - low, np.uint8)])
        self._ends[self.n + 1 : n + 1] = low + ends[1:] - ends[0]
        self._data[low:high] = np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        self.n = n

    def joined(self, at: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
        """The strings at ``at``, joined in runs that end before the positions ``ends``."""
        buffers = [None, pa.py_buffer(self._ends), pa.py_buffer(self._data)]
        taken = pa.BinaryArray.from_buffers(pa.binary(), self.n, buffers).take(pa.array(at))
        if not len(at):
            return pa.array([b""] * len(ends), pa.binary())
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)[np.concatenate([[0], ends])]
        return pa.BinaryArray.from_buffers(
            pa.binary(), len(ends), [None, pa.py_buffer(offsets), taken.buffers()[2]]
        )


class _Places(dict):
    """Words numbered as they are met."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


class _Words:
    """A worker's table of words: those that were folded, and rare ones merged when met."""

    def __init__(self, folded: pa.Table, path: str):
        ranks = bpe.load_ranks(path)
        self.merger = bpe.Merger(ranks)
        # By id: the decimal number after a comma, and the piece.
        self.numbers, self.spelled = _Pieces(), _Pieces()
        pieces = {rank: piece for piece, rank in ranks.items()}
        every = range(max(pieces) + 1)
        self.numbers.extend(pa.array([b",%d" % i for i in every], pa.binary()))
        self.spelled.extend(pa.array([pieces.get(i, b"") for i in every], pa.binary()))

        folded = folded.combine_chunks()
        self.places = _Places(zip(folded["word"].to_pylist(), range(len(folded))))
        self.ids, self.decoded, self.sizes = _Pieces(), _Pieces(), np.zeros(1 << 10, dtype=np.int64)
        for some in folded.to_batches():
            self._add(some["ids"].cast(pa.binary()), some["n"].to_numpy(), some["decoded"])

    def _add(self, ids: pa.BinaryArray, sizes: np.ndarray, decoded: pa.BinaryArray) -> None:
        n = self.ids.n
        self.ids.extend(ids)
        self.decoded.extend(decoded)
        if self.ids.n > len(self.sizes):
            self.sizes = np.concatenate([self.sizes, np.zeros(self.ids.n, dtype=np.int64)])
        self.sizes[n : self.ids.n] = sizes

    def _merge(self, words: list[str]) -> None:
        ids, sizes = self.merger.encode([word.encode() for word in words])
        ends = np.cumsum(sizes)
        self._add(self.numbers.joined(ids, ends), sizes, self.spelled.joined(ids, ends))

    def _forget(self, n: int) -> None:
        """Let all words but the first ``n`` go."""
        while len(self.places) > n:
            self.places.popitem()
        self.ids.n = self.decoded.n = n

    def encode(self, doc_ids: list, texts: list[list[str]]) -> pa.RecordBatch:
        """A row for each text, given as its words."""
        before, ends = len(self.places), np.cumsum([len(words) for words in texts])
        every = map(self.places.__getitem__, chain.from_iterable(texts))
        at = np.fromiter(every, dtype=np.int32, count=ends[-1])
        if new := len(self.places) - before:
            self._merge(list(islice(reversed(self.places), new))[::-1])
        sums = np.concatenate([[0], np.cumsum(self.sizes[at])])[np.concatenate([[0], ends])]
        ids = self.ids.joined(at, ends).cast(pa.string())
        made = [
            pa.array(doc_ids, pa.int64()), pa.array(np.diff(sums)),
            pc.utf8_slice_codeunits(ids, 1), self.decoded.joined(at, ends),
        ]
        if self.ids.n > KEPT + FREQUENT or self.ids.bytes() + self.decoded.bytes() > KEPT_BYTES:
            self._forget(before)
        return pa.RecordBatch.from_arrays(made, schema=_ENCODED)


_ENCODED = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.binary())]
)


def _words(name: str, shared, path: str) -> _Words:
    """The worker's table for the dictionary of this name."""
    kept = common.worker_table("byte_bpe")
    if kept.get("name") != name:
        kept.clear()
        kept["words"] = _Words(pa.ipc.open_stream(shared.value).read_all(), path)
        kept["name"] = name
    return kept["words"]
