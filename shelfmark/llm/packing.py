"""Vector bin packing of token sequences.

Every example has a demand vector: tokens, segments (one) and loss-bearing tokens. Each task
packs the examples it reads, as they come, into a bounded set of open sequences. An example
goes to the open sequence where the dot product of its demand with the remaining room, both
as shares of the limits, is largest among those with room for all of it. Where none has room
it is cut at the first limit. Sequences are closed when a limit is reached and at the end of
a task; the rest is cut into runs whose lengths are powers of two, which need no padding.

Nothing is shuffled and a task holds at most ``OPEN`` sequences, however large the input.
Sequence numbers carry the task's number in their upper bits, so they are unique, and a task
that is run again after a loss packs the same rows in the same way.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common, word_tokens

OPEN = 64
TASK_SHIFT = 36
#: Bytes of text that are tokenized at once.
TOKENIZED = 1 << 20
PIECES = (
    "doc_id long, start long, length long, loss long, doc_tokens long, sequence_id long, "
    "offset long, ids binary"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in "doc_id start length loss doc_tokens sequence_id offset".split()]
    + [("ids", pa.binary())]
)
INSTRUCTION_PIECES = PIECES.replace("doc_id long", "doc_id long, turn long")
_INSTRUCTION_ARROW = _ARROW.insert(1, pa.field("turn", pa.int64()))


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")


@dataclass
class Example:
    """The part of a document from ``start`` on; ``loss[i]`` tells if its token i bears loss.

    ``doc_id`` is handed through to the pieces; of a turn it is the conversation and the turn.
    """

    doc_id: int | tuple | None
    ids: np.ndarray
    loss: np.ndarray
    start: int = 0

    def take(self, n: int) -> tuple[np.ndarray, int, int]:
        """The next ``n`` ids, their position and their loss-bearing tokens."""
        at = self.start
        self.start += n
        return self.ids[at : at + n], at, int(self.loss[at : at + n].sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """How many of the next ``tokens`` ids stay within ``loss``."""
        bearing = np.cumsum(self.loss[self.start : self.start + tokens])
        return int(np.searchsorted(bearing, loss, side="right"))


class Packer:
    """Open sequences of one task."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.room = np.zeros((0, 3), dtype=np.int64)
        self.bins: list[list[tuple]] = []
        self.next_id = first_id

    def place(self, example: Example) -> Iterator[tuple]:
        """Put a whole example away; yields the pieces of sequences that get closed."""
        total = len(example.ids)
        while example.start < total:
            rest = example.ids[example.start :]
            demand = np.array([len(rest), 1, example.loss[example.start :].sum()])
            fits = (self.room >= demand).all(axis=1)
            if fits.any():
                value = (self.room / self.limits) @ (demand / self.limits)
                at = int(np.where(fits, value, -1.0).argmax())
                n = len(rest)
            else:
                if len(self.bins) < OPEN:
                    self.bins.append([])
                    self.room = np.vstack([self.room, self.limits.astype(np.int64)])
                    at = len(self.bins) - 1
                else:
                    at = int(self.room[:, 0].argmin())  # the fullest gets a cut piece
                n = example.fitting(int(self.room[at, 0]), int(self.room[at, 2]))
            if n:
                ids, start, loss = example.take(n)
                self.bins[at].append((example.doc_id, ids, start, loss, total, example.loss))
                self.room[at] -= (n, 1, loss)
            if not n or self.room[at].min() == 0:
                yield from self.close(at)

    def close(self, at: int) -> Iterator[tuple]:
        """End a sequence; if it is not full, as runs of power-of-two lengths."""
        pieces = self.bins.pop(at)
        self.room = np.delete(self.room, at, axis=0)
        filled = sum(len(p[1]) for p in pieces)
        cap, offset = int(self.limits[0]), 0
        run = filled if filled == cap else _power(filled)
        for doc_id, ids, start, loss, total, flags in pieces:
            done = 0
            while done < len(ids):
                n = min(run - offset, len(ids) - done)
                part = ids[done : done + n]
                bearing = int(flags[start + done : start + done + n].sum())
                yield doc_id, start + done, n, bearing, total, self.next_id, offset, part.tobytes()
                done, offset, filled = done + n, offset + n, filled - n
                if offset == run:
                    self.next_id += 1
                    offset, run = 0, _power(filled)

    def end(self) -> Iterator[tuple]:
        """Join what is open as far as the limits allow, then close everything."""
        open_bins = sorted(self.bins, key=lambda b: -sum(len(p[1]) for p in b))
        self.bins, self.room = [], np.zeros((0, 3), dtype=np.int64)
        while open_bins:
            self.bins.append(open_bins.pop(0))
            used = [sum(len(p[1]) for p in self.bins[0]), len(self.bins[0]), sum(p[3] for p in self.bins[0])]
            self.room = (self.limits - used).astype(np.int64)[None, :]
            while open_bins and self.room[0].min() > 0:
                doc_id, ids, start, loss, total, flags = open_bins[-1].pop(0)
                last = start + len(ids)
                part = Example(doc_id, np.zeros(last), flags[:last], start)
                n = part.fitting(min(len(ids), int(self.room[0, 0])), int(self.room[0, 2]))
                if n:
                    bearing = int(flags[start : start + n].sum())
                    self.bins[0].append((doc_id, ids[:n], start, bearing, total, flags))
                    self.room[0] -= (n, 1, bearing)
                if n < len(ids):
                    left = int(flags[start + n : last].sum())
                    open_bins[-1].insert(0, (doc_id, ids[n:], start + n, left, total, flags))
                if not open_bins[-1]:
                    open_bins.pop()
                if not n:
                    break
            yield from self.close(0)


def _power(n: int) -> int:
    """The largest power of two that is at most ``n``; 0 for 0."""
    return 1 << (n.bit_length() - 1) if n else 0


def pack_examples(examples: Iterable[Example], limits: Limits, first_id: int = 0) -> Iterator[tuple]:
    """Rows of ``PIECES`` for the examples, in the order in which sequences are closed."""
    packer = Packer(limits, first_id)
    for example in examples:
        yield from packer.place(example)
    yield from packer.end()


def _first_id() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << TASK_SHIFT


def _tokenized(batches: Iterable[pa.RecordBatch], tokenizer_path: str, end_id: int) -> Iterator[tuple]:
    """The rows of the batches, with ids and ``end_id`` in place of the column ``text``."""
    encoder = word_tokens.encoder(tokenizer_path)
    end = np.array([end_id], dtype="<u4")
    for batch in common.text_batches(batches, "text", TOKENIZED):
        columns = [
            encoder.many(c) if name == "text" else c.to_pylist()
            for name, c in zip(batch.schema.names, batch.columns)
        ]
        at = batch.schema.names.index("text")
        for row in zip(*columns):
            yield *row[:at], np.concatenate([row[at], end]), *row[at + 1 :]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokenize documents and pack them; returns ``PIECES``.

    Each document's ids are followed by ``end_id``; all bear loss. A null or empty text is
    ``end_id`` alone. A null id stays null, repeated rows are packed each for itself, other
    columns are left behind, and an empty table gives no rows.
    """

    def run(batches):
        def examples():
            for doc_id, ids in _tokenized(batches, tokenizer_path, end_id):
                yield Example(doc_id, ids, np.ones(len(ids), dtype=np.int8))

        yield from common.batched(pack_examples(examples(), limits, _first_id()), _ARROW, 500)

    return common.texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def pack_instructions(
    turns: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1,
    loss_role: str = "assistant",
) -> DataFrame:
    """Pack dialogue turns (``conv_id, turn, role, text``), each as one segment.

    Only the tokens of turns of ``loss_role`` bear loss. Returns ``INSTRUCTION_PIECES``: the
    conversation is the ``doc_id``, and ``start`` counts within the turn. Nulls are treated as
    in ``pack_documents``; a turn without a role bears no loss, one without a number has none.
    """
    common.importable(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("doc_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"),
    )

    def run(batches):
        def examples():
            for doc_id, turn, ids, loss in _tokenized(batches, tokenizer_path, end_id):
                yield Example((doc_id, turn), ids, np.full(len(ids), loss, dtype=np.int8))

        packed = pack_examples(examples(), limits, _first_id())
        made = ((*key, *piece) for key, *piece in packed)
        yield from common.batched(made, _INSTRUCTION_ARROW, 500)

    return rows.mapInArrow(run, INSTRUCTION_PIECES)
