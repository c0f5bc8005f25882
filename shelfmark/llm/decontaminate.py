"""Benchmark decontamination: an FM-index for each shard of the training texts.

A task takes its texts in shards. Of each it keeps the runs of benchmark words that are as long
as the shortest window, for no other words can be part of an occurrence, and indexes them
(``fm_index``). All windows of the benchmark are searched backwards at once, their occurrences
are located by sampled suffix positions and merged into spans. The benchmark comes in blocks of
a bounded size; texts are never moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common
from shelfmark.llm.fm_index import FMIndex
from shelfmark.session import materialize

#: Words of a window; a shorter item is one window.
WINDOW = 10
#: Bytes of benchmark text that are searched for, hence broadcast, at once.
BLOCK_BYTES = 4 * 2**20
#: A shard ends when it has so many words to index, or so many bytes of text.
SHARD_WORDS, SHARD_BYTES = 1 << 18, 32 * 2**20

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
# For UTF-8: letters to lower case, digits and all of other characters stay, the rest is a blank.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


class Windows:
    """The windows of a block of items: distinct ones by length, and the items that have them."""

    def __init__(self, items: Iterable[tuple[str, str]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            size = min(window, len(words))
            for low in range(len(words) - size + 1 if words else 0):
                seen.setdefault(tuple(words[low : low + size]), set()).add(item)
        self.phrases: list[np.ndarray] = []  # rows of one length each
        self.items: list[list[list[str]]] = []  # of each row
        for size in sorted({len(w) for w in seen}):
            some = [w for w in seen if len(w) == size]
            self.phrases.append(np.array(some, dtype=np.int64))
            self.items.append([sorted(seen[w]) for w in some])
        self.shortest = min((p.shape[1] for p in self.phrases), default=0)


class Shard:
    """Texts whose runs of benchmark words are indexed together."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.sizes: list[int] = []  # words of each text
        self.runs: list[np.ndarray] = []
        self.places: list[tuple[int, int, int]] = []  # text, first word and length of each run
        self.words = self.bytes = 0

    def add(self, text: str) -> None:
        words = words_of(text)
        known = self.windows.numbers
        numbers = np.array([known.get(w, 0) for w in words], dtype=np.int64)
        inside = np.concatenate([[False], numbers > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        for low, high in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if self.windows.phrases and high - low >= self.windows.shortest:
                self.runs += [numbers[low:high], _END]
                self.places.append((len(self.sizes), low, high - low))
                self.words += high - low + 1
        self.sizes.append(len(words))
        self.bytes += len(text)

    def full(self) -> bool:
        return self.words >= SHARD_WORDS or self.bytes >= SHARD_BYTES

    def found(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """For each text the spans of words that windows cover, merged, and their items."""
        spans: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        items: list[set[str]] = [set() for _ in self.sizes]
        if not self.places:
            return spans, items
        symbols = np.concatenate(self.runs)
        texts, lows, lengths = np.array(self.places).T
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        index = FMIndex(symbols, len(self.windows.numbers) + 1)
        cover = np.zeros(len(symbols) + 1, dtype=np.int64)
        for phrases, owners in zip(self.windows.phrases, self.windows.items):
            which, low, high = index.search(phrases)
            times = high - low
            rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + phrases.shape[1], -1)
            text = texts[np.searchsorted(starts, at, side="right") - 1]
            pairs = np.unique(np.stack([text, np.repeat(which, times)]), axis=1)
            for t, w in pairs.T.tolist():
                items[t].update(owners[w])
        hit = np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]])
        edges = np.flatnonzero(np.diff(hit))
        for low, high in zip(edges[::2], edges[1::2]):  # no span passes the end of a run
            run = int(np.searchsorted(starts, low, side="right")) - 1
            first = int(lows[run] + low - starts[run])
            spans[texts[run]].append((first, first + int(high - low)))
        return spans, items


_END = np.zeros(1, dtype=np.int64)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", _SPANS),
     ("items", pa.list_(pa.string()))]
)
_FOUND_SPARK = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _scan(rows: Iterator[tuple], windows: Windows, with_text: bool) -> Iterator[tuple]:
    """Rows ``(doc_id, text, spans, items)`` with what this block of windows adds."""
    held: list[tuple] = []
    shard = Shard(windows)

    def flush() -> Iterator[tuple]:
        for (doc_id, text, spans, items), size, more, owners in zip(held, shard.sizes, *shard.found()):
            both = merged([*((s["start"], s["end"]) for s in spans), *more]) if spans else more
            ends = [{"start": a, "end": b} for a, b in both]
            yield doc_id, text if with_text else None, size, ends, sorted(owners.union(items))

    for row in rows:
        held.append(row if with_text else (row[0], None, *row[2:]))
        shard.add(row[1])
        if shard.full():
            yield from flush()
            held, shard = [], Shard(windows)
    yield from flush()


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row.

    ``spans`` are the runs ``[start, end)`` of words that any occurrence of a window of
    ``window`` consecutive item words covers, in order and apart; ``items`` the ids, as text,
    of the items that have such windows, in text order. An item of fewer words is one window.
    Words are runs of digits, letters a-z after lower-casing A-Z, and all characters beyond
    ASCII. Null, empty and wordless texts have no spans, and such items no windows; items
    without an id take no part; rows of one item id are one item. Repeated rows of ``docs`` are
    searched each, null ids stay null. An empty benchmark finds nothing, an empty table gives
    no rows. Other columns are left behind.

    At most about ``block_bytes`` of benchmark text (a single item may be longer) are broadcast
    at once; a larger benchmark takes one pass over the texts for each block, and what is found
    is stored in between.
    """
    rows = common.texts(docs, id_col, text_col)
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text")
    )
    return _search(rows, items, window, block_bytes, False).drop("text")


def _search(rows: DataFrame, items: DataFrame, window: int, block_bytes: int, with_text: bool) -> DataFrame:
    spark = rows.sparkSession
    items = items.where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = rows.select(
        "doc_id", "text", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        last = k == blocks - 1

        def run(batches, block=block, keep=with_text or not last):
            made = _scan(common.rows_of(batches), Windows(block.value, window), keep)
            yield from common.batched(made, _FOUND, 500)

        found = found.select("doc_id", "text", "spans", "items").mapInArrow(run, _FOUND_SPARK)
        if not last:
            found = materialize(found, "passages")
    return found


def hit_words(spans: Column) -> Column:
    """How many words spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    for low, high in reversed(spans):
        text = text[: places[low][0]] + text[places[high - 1][1] :]
    return text


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, text`` of every row, without the passages that ``find_passages`` finds.

    Texts without such passages stay as they are; a null text is empty.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    found = _search(common.texts(docs), items, window, block_bytes, True)

    def cut(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("text", "spans")))
            texts = [cut_spans(t, [(s["start"], s["end"]) for s in spans]) for t, spans in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return found.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, text string")
