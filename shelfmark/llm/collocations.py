"""Phrase collocations by best-first branch-and-bound growth.

Texts are written once as chunks of numbered words; the chunk's words carry 64-bit ids, which
are checked to differ for all words of the corpus. A word that is too rare to be in a phrase
ends a piece; the chunks are written again without such words, and all passes read those. A
phrase is a row of up to five ids, counted by exact grouping.

A phrase that begins with ``w`` scores at most ``1000 * n / f(w)``, for the cut after ``w`` has
``l = f(w)`` and ``r >= a``. So first words in classes of rising counts are the frontier, the
best bound first. In each round

1. the frontier's words grow by a word at a time, as long as the count stays high enough,
2. the parts of the phrases found are counted, and what stands to the left of each,
3. phrases that survive are scored, which raises each language's threshold.

A language is settled when the bound of all words that are left is below its last reported
score. Sets of phrases reach the tasks as sorted keys, ``SET_ROWS`` at most at once; keys only
select what is counted, so equal keys of different phrases do no harm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm import common
from shelfmark.session import literal_frame, materialize

MIN_COUNT, LONGEST, REPORTED = 100, 5, 2000
#: Bytes of text in a chunk.
CHUNK_BYTES = 3 * 2**20
#: Phrases that tasks look for in one pass; more take more passes.
SET_ROWS = 1 << 18
#: Bits that say, by the last bits of an id, which words may be in a phrase.
LIVE_BITS = 1 << 24
#: Every chunk is a row group without dictionaries, so neither writer nor reader holds several.
_LAID = {"parquet.block.row.count.limit": "1", "parquet.enable.dictionary": "false"}
#: Parts in which the phrases of a language are ranked first.
RANK_PARTS = 64
#: Rows that a task sends to Spark at once.
SENT_ROWS = 1 << 15
#: The first round takes first words of a sixteenth of a language, each further one four times more.
FIRST_SHARE, FASTER = 16, 4
#: Classes of counts for each doubling.
CLASSES = 4

_MARK, _BLANK = 255, 32  # 255 is in no UTF-8 text: it ends a piece
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else _MARK if c in b".,;:!?\n\x0b\x0c\r" else _BLANK if c == 9 else c
    for c in range(256)
)
_W = [f"w{i}" for i in range(1, LONGEST + 1)]

# --- chunks of numbered words ------------------------------------------------------------------


def _mixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of what ``key`` stands for, with one 64-bit word more."""
    return ((key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) + word


def _eights(window: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next up to eight bytes of words that have ``left`` bytes left, as numbers."""
    read = window[starts].view(np.uint64).ravel()
    unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    return (read << unused) >> unused


_WORDS = pa.list_(pa.struct([("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))
_CHUNKS = pa.schema([("seq", pa.binary()), ("ids", pa.binary()), ("words", _WORDS)])
_CHUNKS_SPARK = "seq binary, ids binary, words array<struct<id:long,lang:string,word:string,n:long>>"


def _chunk(langs: list[str], texts: list[bytes], salt: int) -> pa.RecordBatch:
    """Whole texts as one chunk.

    ``seq`` holds the numbers of the words in order and a 0 wherever a piece ends; ``ids`` the
    ids of the words 1, 2, …; ``words`` what they stand for and their counts.
    """
    joined = b"\xff".join([*texts, b""])
    data = np.frombuffer(joined + bytes(8), dtype=np.uint8)
    window = np.lib.stride_tricks.sliding_window_view(data, 8)
    marks = data[: len(joined)] == _MARK
    inside = np.concatenate([[False], ~marks & (data[: len(joined)] != _BLANK), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    starts, sizes = edges[::2].copy(), edges[1::2] - edges[::2]
    ends = np.flatnonzero(marks)
    del inside, edges, marks

    names = sorted(set(langs))
    of_text = np.array([names.index(lang) for lang in langs], dtype=np.int32)
    after = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    lang = np.repeat(of_text, np.diff(after, prepend=0))
    seeds = np.array([xxhash.xxh64_intdigest(name.encode(), salt) for name in names], dtype=np.uint64)
    ids = _mixed(seeds[lang], sizes.astype(np.uint64))
    left = np.arange(len(starts), dtype=np.int32)
    for at in range(0, int(sizes.max(initial=0)), 8):
        left = left[sizes[left] > at]
        ids[left] = _mixed(ids[left], _eights(window, starts[left] + at, sizes[left] - at))
    ids ^= ids >> np.uint64(32)
    distinct, firsts, numbers = np.unique(ids, return_index=True, return_inverse=True)
    numbers = numbers.astype(np.int32)
    del ids
    if not _same(window, starts, sizes, lang, firsts[numbers]):
        distinct = np.zeros_like(distinct)  # no id is 0: another salt is taken

    is_word = np.ones(len(starts) + len(ends), dtype=bool)
    is_word[np.arange(len(ends)) + np.searchsorted(starts, ends)] = False
    seq = np.zeros(len(is_word), dtype=np.int32)
    seq[is_word] = numbers + 1
    spelled = [joined[a : a + n] for a, n in zip(starts[firsts].tolist(), sizes[firsts].tolist())]
    columns = [
        pa.array(distinct.view(np.int64)), pa.array(names, pa.string()).take(pa.array(lang[firsts])),
        pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(np.bincount(numbers, minlength=len(distinct)), pa.int64()),
    ]
    structs = pa.StructArray.from_arrays(columns, fields=list(_WORDS.value_type))
    words = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (seq, distinct)]
    return pa.RecordBatch.from_arrays([*blobs, words.cast(_WORDS)], schema=_CHUNKS)


def _same(window: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lang: np.ndarray, firsts: np.ndarray) -> bool:
    """Every word equals the first one of its id, byte by byte."""
    if (sizes != sizes[firsts]).any() or (lang != lang[firsts]).any():
        return False
    left = np.flatnonzero(firsts != np.arange(len(firsts)))
    for at in range(0, int(sizes.max(initial=0)), 8):
        left = left[sizes[left] > at]
        rest = sizes[left] - at
        if (_eights(window, starts[left] + at, rest) != _eights(window, starts[firsts[left]] + at, rest)).any():
            return False
    return True


def _chunks(rows: Iterable[tuple[str, str]], salt: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(lang, text)`` as chunks."""
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for lang, text in rows:
        langs.append(lang)
        texts.append(text.encode().translate(_BYTES))
        size += len(texts[-1])
        if size >= CHUNK_BYTES:
            yield _chunk(langs, texts, salt)
            pa.default_memory_pool().release_unused()
            langs, texts, size = [], [], 0
    if texts:
        yield _chunk(langs, texts, salt)


# --- counting phrases in chunks ----------------------------------------------------------------


def _key(words: list[np.ndarray]) -> np.ndarray:
    """Keys of phrases whose words, of one length, stand in columns."""
    key = words[0].view(np.uint64)
    for word in words[1:]:
        key = _mixed(key, word.view(np.uint64))
    return key


def _among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are in a sorted set."""
    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


class _Chunk:
    """A chunk's sequence of word numbers and the ids they stand for."""

    def __init__(self, seq: bytes, ids: bytes):
        self.seq = np.frombuffer(seq, dtype=np.int32)
        self.ids = np.concatenate([np.zeros(1, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)])

    def places(self, firsts: np.ndarray, keys: np.ndarray, size: int, more: int) -> np.ndarray:
        """Where a phrase of ``size`` words, by its first word and its key, stands with at
        least ``more`` words after it in its piece."""
        begins = _among(firsts, self.ids)[self.seq]
        begins[0 if len(self.seq) < size + more else len(self.seq) - size - more + 1 :] = False
        at = np.flatnonzero(begins)
        for i in range(1, size + more):
            at = at[self.seq[at + i] != 0]
        return at if size == 1 else at[_among(keys, _key(self.words(at, size)))]

    def words(self, at: np.ndarray, size: int) -> list[np.ndarray]:
        return [self.ids[self.seq[at + i]] for i in range(size)]


def _chunks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[_Chunk]:
    for batch in batches:
        for seq, ids in zip(batch.column(0), batch.column(1)):
            yield _Chunk(seq.as_buffer(), ids.as_buffer())
            pa.default_memory_pool().release_unused()


def pruned(chunks: DataFrame, live: DataFrame) -> DataFrame:
    """The chunks' ``seq`` and ``ids`` without words that are not in ``live(w1)``.

    A phrase has no other words, nor can one stand before all occurrences of a phrase. Words
    with the last bits of a live one stay, which does no harm and bounds what tasks are sent.
    """
    last = F.col("w1").bitwiseAND(F.lit(LIVE_BITS - 1))
    bits = np.zeros(LIVE_BITS, dtype=bool)
    bits[live.select(last.alias("bit")).distinct().toArrow().column(0).to_numpy()] = True
    shared = chunks.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def run(batches):
        bits = shared.value
        for chunk in _chunks_of(batches):
            bit = chunk.ids & (LIVE_BITS - 1)
            stays = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            stays[0] = False
            seq = np.where(stays, np.cumsum(stays, dtype=np.int32), np.int32(0))[chunk.seq]
            shown = seq != 0
            shown[1:] |= shown[:-1].copy()  # of marks in a row one stays
            blobs = [seq[shown].tobytes(), chunk.ids[stays].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in blobs], ["seq", "ids"])

    rows = chunks.select("seq", "ids").mapInArrow(run, "seq binary, ids binary")
    return materialize(rows, "pruned-chunks", _LAID)


def _tallied(words: list[np.ndarray], left: np.ndarray | None = None) -> pa.RecordBatch:
    """Distinct rows of words with their counts, and the least and largest ``left`` of each."""
    order = np.argsort(_key(words), kind="stable")
    words = [w[order] for w in words]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    starts = np.flatnonzero(new)
    columns = [w[starts] for w in words]
    columns += [np.zeros(len(starts), dtype=np.int64)] * (LONGEST - len(words))
    columns.append(np.diff(np.append(starts, len(order))))
    if left is not None:
        some = left[order]
        columns += [f.reduceat(some, starts) if len(starts) else some for f in (np.minimum, np.maximum)]
    names = [*_W, "n", "lo", "hi"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names[: len(columns)])


def _sent(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in parts, so that Spark never holds all of a chunk's."""
    for low in range(0, rows.num_rows, SENT_ROWS):
        yield rows.slice(low, SENT_ROWS)


_COUNTED = ", ".join(f"{w} long" for w in _W) + ", n long"
_Set = dict[int, tuple[np.ndarray, np.ndarray]]


def _sets(phrases: DataFrame) -> Iterator[_Set]:
    """Phrases ``w1, …, w5`` as sets of at most about ``SET_ROWS``.

    A set has for each number of words the first words and the keys of the phrases, sorted.
    """
    parts = -(-phrases.count() // SET_ROWS)
    for part in range(parts):
        mine = phrases.where(F.pmod(F.xxhash64(*_W), F.lit(parts)) == part) if parts > 1 else phrases
        words = [c.to_numpy() for c in mine.select(*_W).toArrow().columns]
        sizes = sum((w != 0).astype(int) for w in words)
        made: _Set = {}
        for size in np.unique(sizes).tolist():
            some = [np.ascontiguousarray(w[sizes == size]) for w in words[:size]]
            made[size] = np.unique(some[0]), np.unique(_key(some))
        yield made


def _none(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, without Python workers."""
    return literal_frame(spark, [], T.StructType.fromDDL(schema))


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def grow(chunks: DataFrame, phrases: DataFrame, least: int) -> DataFrame:
    """``w1, …, w5, n`` of phrases that have one word more than one of ``phrases`` at the end
    and occur ``least`` times."""
    spark = chunks.sparkSession
    found = [_none(spark, _COUNTED)]
    for wanted in _sets(phrases):
        shared = spark.sparkContext.broadcast(wanted)

        def run(batches, shared=shared):
            for chunk in _chunks_of(batches):
                for size, (firsts, keys) in shared.value.items():
                    at = chunk.places(firsts, keys, size, 1)
                    yield from _sent(_tallied(chunk.words(at, size + 1)))

        counted = chunks.select("seq", "ids").mapInArrow(run, _COUNTED)
        found.append(counted.groupBy(*_W).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return _union(found)


def tally(chunks: DataFrame, phrases: DataFrame) -> DataFrame:
    """``w1, …, w5, n, alone`` of the given phrases, and perhaps of others.

    ``alone`` is the word that stands before every occurrence; it is null where several do, or
    where the phrase begins a piece.
    """
    spark = chunks.sparkSession
    parts = [_none(spark, _COUNTED + ", lo long, hi long")]
    for wanted in _sets(phrases):
        shared = spark.sparkContext.broadcast(wanted)

        def run(batches, shared=shared):
            for chunk in _chunks_of(batches):
                for size, (firsts, keys) in shared.value.items():
                    at = chunk.places(firsts, keys, size, 0)
                    before = np.where(at > 0, chunk.ids[chunk.seq[at - 1]], 0)
                    yield from _sent(_tallied(chunk.words(at, size), before))

        parts.append(chunks.select("seq", "ids").mapInArrow(run, _COUNTED + ", lo long, hi long"))
    lo, hi = F.min("lo"), F.max("hi")
    return _union(parts).groupBy(*_W).agg(
        F.sum("n").alias("n"), F.when((lo == hi) & (lo != 0), lo).alias("alone")
    )


# --- scores ------------------------------------------------------------------------------------


def _phrase(words: list[Column]) -> Column:
    return F.filter(F.array(*words), lambda w: w != 0)


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """``floor(1000 * a * n / (l * r))`` in decimals of 38 digits."""
    a, n, left, right = (x.cast("decimal(18,0)") for x in (F.lit(1000) * a, n, left, right))
    return F.call_function("div", a * n, left * right).cast("long")


def scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``candidates(p, lang, a)`` with the lowest-scoring cut as ``l, r, n, score``.

    ``counts(p, n)`` has both parts of every cut; ``totals(lang, n)`` the words of a language.
    """
    cuts = candidates.select(
        "p", "lang", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("cut")
    ).withColumns(
        {"left": F.slice("p", F.lit(1), F.col("cut")), "right": F.slice("p", F.col("cut") + 1, F.size("p") - F.col("cut"))}
    )
    cuts = cuts.join(counts.select(F.col("p").alias("left"), F.col("n").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("p").alias("right"), F.col("n").alias("r")), "right")
    cuts = cuts.join(totals, "lang")
    best = F.min(F.struct(cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r"))
    return cuts.groupBy("p", "lang", "a", "n").agg(best.alias("best")).select(
        "p", "lang", "a", "n", "best.l", "best.r", "best.score"
    )


def _bound(n: int, count: int) -> int:
    """No phrase whose first word occurs ``count`` times or more scores higher."""
    return 1000 * n // count


class Frontier:
    """Each language's classes of first words that are not grown yet, the best bound first."""

    def __init__(self, words: DataFrame, totals: DataFrame):
        self.totals = {r["lang"]: r["n"] for r in totals.collect()}
        classes = words.groupBy("lang", "class").agg(F.min("n").alias("least"), F.sum("n").alias("all")).collect()
        self.open: dict[str, list] = defaultdict(list)
        for row in sorted(classes, key=lambda r: r["class"]):
            self.open[row["lang"]].append((row["class"], row["least"], row["all"]))
        self.share = FIRST_SHARE

    def settle(self, thresholds: dict[str, int]) -> None:
        """Leave the classes whose bound is below what a language reports last."""
        for lang, classes in self.open.items():
            least = thresholds.get(lang, 0)
            self.open[lang] = [c for c in classes if _bound(self.totals[lang], c[1]) >= least]

    def next(self) -> Column | None:
        """The words of the next round, of every language that is not settled."""
        chosen = None
        for lang, classes in self.open.items():
            room = self.totals[lang] / self.share
            taken: list[int] = []
            while classes and (not taken or room >= classes[0][2]):
                number, _, occurrences = classes.pop(0)
                taken.append(number)
                room -= occurrences
            if taken:
                mine = (F.col("lang") == lang) & F.col("class").between(taken[0], taken[-1])
                chosen = mine if chosen is None else chosen | mine
        self.share /= FASTER
        return chosen


# --- the job -----------------------------------------------------------------------------------


def numbered(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``texts(lang, text)``, and ``id, lang, word, n`` of all their words."""
    salt = 0
    while True:
        def run(batches, salt=salt):
            yield from _chunks(common.rows_of(batches), salt)

        chunks = materialize(texts.mapInArrow(run, _CHUNKS_SPARK), "chunks", _LAID)
        words = chunks.select(F.inline("words")).groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
        words = materialize(words, "words")
        # In a chunk equal ids are equal words; across chunks this tells.
        clash = words.groupBy("id").agg(F.count(F.lit(1)).alias("words")).where((F.col("words") > 1) | (F.col("id") == 0))
        if clash.isEmpty():
            return chunks, words
        salt += 1


def mine_phrases(
    docs: DataFrame, reported: int = REPORTED, min_count: int = MIN_COUNT,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best collocations.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces into
    words at blanks and tabs. Candidates are phrases of two to five words that occur
    ``min_count`` times or more within pieces; a phrase's score is that of its lowest-scoring
    cut. A candidate goes if a longer one holds it and is as frequent. The first ``reported``
    of a language by score, count and text are returned. A null language is ``und``; null and
    empty texts have no words; repeated rows count each; an empty table gives no rows.
    Other columns are left behind.
    """
    common.importable(docs.sparkSession)
    texts = docs.select(
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    chunks, words = numbered(texts)
    totals = materialize(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    live = words.where(F.col("n") >= min_count).select(
        F.col("id").alias("w1"), "lang", "word", "n", F.floor(F.log2("n") * CLASSES).alias("class")
    )
    live = materialize(live, "live-words")
    chunks = pruned(chunks, live)
    single = live.select(F.array("w1").alias("p"), "n")
    kept: list[DataFrame] = []
    thresholds: dict[str, int] = {}
    frontier = Frontier(live, totals)
    while (chosen := frontier.next()) is not None:
        seeds = materialize(live.where(chosen).select("w1", "lang"), "frontier")
        kept.append(_round(chunks, seeds, single, totals, thresholds, min_count))
        thresholds = _thresholds(kept, reported)
        frontier.settle(thresholds)
    return _report(kept, live, thresholds, reported, docs)


def _round(
    chunks: DataFrame, seeds: DataFrame, single: DataFrame, totals: DataFrame,
    thresholds: dict[str, int], min_count: int,
) -> DataFrame:
    """Surviving phrases that begin with a seed, with their scores; those that can no longer be
    reported may be missing."""
    levels = [seeds.select("w1", *[F.lit(0).cast("long").alias(w) for w in _W[1:]])]
    for size in range(2, LONGEST + 1):
        levels.append(materialize(grow(chunks, levels[-1], min_count), f"phrases-{size}"))
    grown = _union(levels[1:])
    grown = grown.join(seeds, "w1").select(*_W, "lang", F.col("n").alias("a"), _phrase([F.col(w) for w in _W]).alias("p"))
    # Longer phrases that follow every occurrence of a shorter one.
    longer = grown.where(F.size("p") > 2).select(F.slice("p", F.lit(1), F.size("p") - 1).alias("p"), "a").distinct()
    left = grown.join(longer, ["p", "a"], "left_anti")
    left = materialize(_hopeful(left, single, totals, thresholds), "candidates")
    # Parts of a phrase after a cut that are no single words, and what stands before the phrase.
    suffixes = left.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.size("p")),
                lambda i: F.when(i < F.size("p"), F.slice("p", i, F.size("p"))).otherwise(F.col("p")),
            )
        ).alias("q")
    ).where(F.size("q").between(2, LONGEST - 1))
    asked = suffixes.distinct().select(
        *[F.coalesce(F.get("q", F.lit(i)), F.lit(0)).alias(w) for i, w in enumerate(_W)]
    )
    found = tally(chunks, materialize(asked, "parts"))
    found = materialize(found.select(_phrase([F.col(w) for w in _W]).alias("p"), "n", "alone"), "tallied")
    held = found.where("alone is not null").select("p")
    survivors = left.where(F.size("p") == LONGEST).unionByName(
        left.where(F.size("p") < LONGEST).join(held, "p", "left_anti")
    )
    prefixes = grown.select("p", F.col("a").alias("n"))
    counts = single.unionByName(prefixes).unionByName(found.select("p", "n").join(prefixes, "p", "left_anti"))
    return materialize(scored(survivors.select("p", "lang", "a"), counts, totals), "survivors")


def _hopeful(grown: DataFrame, single: DataFrame, totals: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """Candidates whose cut before the last word does not rule them out.

    The count of the last word and ``l >= a`` bound the score by ``1000 * n / r``.
    """
    if not thresholds:
        return grown.select("p", "lang", "a")
    least = F.lit(0)
    for lang, score in thresholds.items():
        least = F.when(F.col("lang") == lang, F.lit(score)).otherwise(least)
    last = single.select(F.get("p", F.lit(0)).alias("last"), F.col("n").alias("r"))
    rows = grown.withColumn("last", F.element_at("p", -1)).join(last, "last").join(totals, "lang")
    bound = cut_score(F.lit(1), F.col("n"), F.lit(1), F.col("r"))
    return rows.where(bound >= least).select("p", "lang", "a")


def _first(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each language with their rank.

    Parts of a language are ranked by themselves before they meet, so a task that ranks a
    whole language has at most ``RANK_PARTS * most`` rows, however many phrases there are.
    """
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("p"), F.lit(RANK_PARTS))).orderBy(*order)
    some = rows.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    whole = Window.partitionBy("lang").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= most)


def _thresholds(kept: list[DataFrame], reported: int) -> dict[str, int]:
    """The last reported score of each language that has enough phrases."""
    best = _first(_union(kept).select("p", "lang", "score"), [F.desc("score")], reported)
    last = best.groupBy("lang").agg(F.max("rank").alias("rank"), F.min("score").alias("score"))
    return {r["lang"]: r["score"] for r in last.where(F.col("rank") == reported).collect()}


_RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def _report(
    kept: list[DataFrame], live: DataFrame, thresholds: dict[str, int], reported: int, docs: DataFrame
) -> DataFrame:
    if not kept:
        return _none(docs.sparkSession, _RESULT)
    rows = _union(kept)
    for lang, score in thresholds.items():
        rows = rows.where((F.col("lang") != lang) | (F.col("score") >= score))
    spelled = (
        rows.select("*", F.posexplode("p").alias("at", "w1")).join(live.select("w1", "word"), "w1")
        .groupBy("p", "lang", "a", "l", "r", "n", "score")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("phrase"))
    )
    ranked = _first(spelled, [F.desc("score"), F.desc("a"), F.col("phrase")], reported)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
