"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its words, parted by white space; its k-mers are runs of five
words, each labelled with how often it has occurred before. For every one of ``SKETCHES``
hash functions the ``PICKED`` smallest labelled k-mers are taken and written down in the order
in which they stand in the text, so a shared sketch speaks for shared runs in the same order.
As many sketches again are of the distinct k-mers without labels, written down by value: they
find what is similar as sets, also where passages have moved or lines are repeated.

1. Equal word sequences form a class at once (a digest, partial aggregation); one text of
   each class goes on.
2. Texts that share a sketch value are joined by an edge to the smallest id with that value:
   one row per text and value, never pairs. Components of these edges are the groups in
   which all near duplicates must lie.
3. Within a group, pairs that share a sketch are verified, most shared first: the exact
   Jaccard similarity of the five-word shingles must reach the threshold. An alignment within
   a narrow band confirms it at once where a few edits cannot take it below; all other pairs,
   moved passages among them, are decided by the shingles. Pairs already linked through others
   need no check, so a group of copies takes about as many checks as it has texts. Large
   groups are cut into blocks, and every two blocks meet in a task of their own.
4. Components of the verified links, with the exact copies, are the classes.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common, graph
from shelfmark.session import materialize

WORDS, SIMILARITY = 5, 0.8
SKETCHES, PICKED = 32, 5
#: Texts of few distinct k-mers have further sketches of their one smallest k-mer.
SHORT_KMERS, SHORT_SKETCHES = 15, 8
#: Edits up to which an alignment is tried before the shingles, and the words it may take.
QUICK_EDITS, QUICK_WORDS = 8, 64
#: Texts of a group that one task holds for each side of a block pair.
BLOCK_ROWS = 1_024
#: Ids up to this number are broadcast; beyond it, texts are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_SEEDS = np.random.default_rng(20_240_131).integers(1, 2**63, SKETCHES + SHORT_SKETCHES, dtype=np.uint64) | np.uint64(1)


#: What ``words_of`` finds a word in, for Spark.
HAS_WORDS = r"(?U)[^\s\x1c-\x1f]"


def words_of(text: str) -> list[str]:
    return text.split()


# --- sketches --------------------------------------------------------------------------------


def kmer_hashes(words: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers in text order, one for shorter texts; and which
    of them are first occurrences, whose hashes are those of the distinct k-mers."""
    table = common.worker_table("near_dup")
    known = table.get
    h = np.array([known(w) or _hash(w, table) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        n = max(1, len(h) - k + 1)
        out = np.zeros(n, dtype=np.uint64)
        for i in range(min(k, len(h))):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        order = np.argsort(out, kind="stable")
        ranked = out[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if not first.all():  # the same k-mer again: label with its occurrence
            starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            label = np.empty(n, dtype=np.uint64)
            label[order] = (np.arange(n) - starts).astype(np.uint64)
            out = out + label * np.uint64(0xC2B2AE3D27D4EB4F)
            return out, label == 0
    return out, np.ones(n, dtype=bool)


#: Word hashes kept in a worker.
KEPT = 300_000


def _hash(word: str, table: dict[str, int]) -> int:
    value = xxhash.xxh64_intdigest(word.encode())
    if len(table) < KEPT:
        table[word] = value
    return value


def sketches_of(kmers: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """A text's sketch values: in text order, by value, and of one k-mer for short texts."""
    values = order_min_hash(kmers, firsts, _SEEDS[:SKETCHES], PICKED)
    distinct = int(firsts.sum())
    if distinct <= SHORT_KMERS:
        values = (*values, order_min_hash(kmers, firsts, _SEEDS[SKETCHES:], 1)[1])
    return np.concatenate(values)


def order_min_hash(
    kmers: np.ndarray, firsts: np.ndarray, seeds: np.ndarray, picked: int
) -> tuple[np.ndarray, np.ndarray]:
    """Two sketch values per hash function: of its smallest k-mers in text order, and of its
    smallest first occurrences by value. Both come from one pass over the k-mers."""
    n = len(kmers)
    once, again = np.flatnonzero(firsts), np.flatnonzero(~firsts)
    ordered, by_value = np.zeros(len(seeds), dtype=np.uint64), np.zeros(len(seeds), dtype=np.uint64)

    def mixed(places: np.ndarray, some: np.ndarray) -> np.ndarray:
        own = kmers[places]
        out = (own ^ (own >> np.uint64(31))) * some[:, None]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out

    def least(places: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and mixed values of the smallest k-mers among ``places``."""
        values, take = mixed(places, some), min(picked, len(places))
        if take == len(places):
            return np.tile(places, (len(some), 1)), values
        at = np.argpartition(values, take - 1, axis=1)[:, :take]
        return places[at], np.take_along_axis(values, at, axis=1)

    def written(chosen: np.ndarray) -> np.ndarray:
        take = chosen.shape[1]
        value = np.full(len(chosen), np.uint64(take))
        for i in range(take):
            value = (value ^ chosen[:, i]) * np.uint64(0x94D049BB133111EB)
            value ^= value >> np.uint64(31)
        return value

    with np.errstate(over="ignore"):
        for low in range(0, len(seeds), max(1, 2_000_000 // n)):
            some = seeds[low : low + max(1, 2_000_000 // n)]
            places, values = least(once, some)
            by_value[low : low + len(some)] = written(np.sort(kmers[places], axis=1))
            if len(again):
                more, more_values = least(again, some)
                places, values = np.hstack([places, more]), np.hstack([values, more_values])
                keep = np.argsort(values, axis=1, kind="stable")[:, : min(picked, n)]
                places = np.take_along_axis(places, keep, axis=1)
            ordered[low : low + len(some)] = written(kmers[np.sort(places, axis=1)])
    return ordered, by_value


def sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, sketches`` of every text with words; ``copy`` digests its words."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.binary()), ("sketches", pa.list_(pa.int64()))])

    def rows(batches):
        for doc_id, text in common.rows_of(batches):
            words = words_of(text)
            if words and doc_id is not None:
                copy = xxhash.xxh128_digest("\n".join(words).encode())
                yield doc_id, copy, sketches_of(*kmer_hashes(words)).view(np.int64)

    def run(batches):
        yield from common.batched(rows(batches), schema, 1000)

    return docs.mapInArrow(run, "doc_id long, copy binary, sketches array<long>")


# --- verification ----------------------------------------------------------------------------


def _between(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of two word sequences without their common start and end."""
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``, by banded alignment.

    The band holds the diagonals within the number of edits allowed, and is doubled until
    the distance fits; on each diagonal the furthest point reachable is kept.
    """
    a, b = _between(a, b)
    if not len(a) or not len(b):
        worst = max(len(a), len(b))
        return worst if worst <= most else None
    band = 8
    while True:
        band = min(band, most)
        found = _aligned(a, b, band)
        if found is not None or band >= most:
            return found
        band *= 2


def _aligned(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    goal = len(b) - len(a)
    if abs(goal) > band:
        return None
    stops: dict[int, list[int]] = {}  # for each diagonal the places in a where words differ

    def reach(diagonal: int, i: int) -> int:
        if diagonal not in stops:
            low, high = max(0, -diagonal), min(len(a), len(b) - diagonal)
            places = np.flatnonzero(a[low:high] != b[low + diagonal : high + diagonal]) + low
            stops[diagonal] = [*places.tolist(), high]
        if i > stops[diagonal][-1]:
            return i
        return stops[diagonal][bisect_left(stops[diagonal], i)]

    far = {0: reach(0, 0)}
    if goal == 0 and far[0] == len(a):
        return 0
    for edits in range(1, band + 1):
        new = {}
        for d in range(-edits, edits + 1):
            if d > len(b) or -d > len(a):
                continue
            i = max(
                far[d] + 1 if d in far else -1,  # a word replaced
                far[d - 1] if d - 1 in far else -1,  # a word of b added
                far[d + 1] + 1 if d + 1 in far else -1,  # a word of a left out
            )
            i = min(i, len(a), len(b) - d)
            if i < max(0, -d):
                continue
            new[d] = reach(d, i)
        far = new
        if far.get(goal) == len(a):
            return edits
    return None


class Text:
    """A text's words as numbers, and its shingles."""

    def __init__(self, text: str, numbers: dict[str, int]):
        words = words_of(text)
        self.words = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        self._shingles: set | None = None

    @property
    def shingles(self) -> set:
        if self._shingles is None:
            w = self.words.tolist()
            self._shingles = set(zip(*(w[i:] for i in range(WORDS)))) if len(w) >= WORDS else {tuple(w)}
        return self._shingles


def similar(a: Text, b: Text, least: float = SIMILARITY) -> bool:
    """The Jaccard similarity of the shingles reaches ``least``, wherever the passages stand.

    An edit of one word changes at most ``WORDS`` shingles of either text, so texts that align
    with few edits are similar without their shingles being met.
    """
    x, y = a.shingles, b.shingles
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    needed = math.ceil(least * (len(x) + len(y)) / (1 + least))
    sure = (max(len(x), len(y)) - needed) // WORDS
    if sure >= 0:
        left, right = _between(a.words, b.words)
        if max(len(left), len(right)) <= QUICK_WORDS and edit_distance(left, right, min(sure, QUICK_EDITS)) is not None:
            return True
    common_ = len(x & y)
    return common_ >= least * (len(x) + len(y) - common_)


class Links:
    """Union of texts that are linked."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)


def verified_links(ids: list[int], texts: list[str], sketches: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all verified pairs, within the one side or between the two."""
    numbers: dict[str, int] = {}
    made: dict[int, Text] = {}

    def text(i: int) -> Text:
        if i not in made:
            made[i] = Text(texts[i], numbers)
        return made[i]

    left = np.flatnonzero(sides == sides[0])
    right = np.flatnonzero(sides != sides[0])
    within = not len(right)
    if within:
        right = left
    shared = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(sketches.shape[1]):
        shared += sketches[left, k][:, None] == sketches[right, k][None, :]
    if within:
        shared[np.tril_indices(len(left))] = 0
    links, out = Links(len(ids)), []
    for count in range(int(shared.max(initial=0)), 0, -1):
        for x, y in zip(*np.nonzero(shared == count)):
            i, j = int(left[x]), int(right[y])
            if links.root(i) != links.root(j) and similar(text(i), text(j)):
                links.join(i, j)
                out.append((ids[i], ids[j]))
    return out


def _group_links(rows: pa.Table) -> pa.Table:
    """Verified links of one block, or between the two blocks that ``side`` tells apart."""
    rows = rows.take(np.argsort(rows["doc_id"].to_numpy(), kind="stable"))
    sketches = np.empty((len(rows), 2 * SKETCHES + SHORT_SKETCHES), dtype=np.int64)
    sketches[:] = -1 - np.arange(len(rows))[:, None]  # equal to no other row's
    for i, own in enumerate(rows["sketches"].to_pylist()):
        sketches[i, : len(own)] = own
    links = verified_links(
        rows["doc_id"].to_pylist(), rows["text"].to_pylist(), sketches, rows["side"].to_numpy()
    )
    return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})


# --- the jobs --------------------------------------------------------------------------------


def candidate_groups(firsts: DataFrame) -> DataFrame:
    """``doc_id, grp`` of texts that share a sketch value, directly or through others."""
    values = firsts.select("doc_id", F.posexplode("sketches").alias("k", "value"))
    leads = (
        values.groupBy("k", "value").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
        .where("lead < last").select("k", "value", "lead")
    )
    edges = values.join(leads, ["k", "value"]).where("doc_id <> lead")
    edges = edges.select(F.col("doc_id").alias("u"), F.col("lead").alias("v"))
    return graph.components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("grp"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``doc_id, class_id`` of every row; a class is named by its smallest id.

    Two texts are linked if the Jaccard similarity of their five-word shingles is 0.8 or more,
    also where passages have moved; classes are what links connect. A text of fewer than five
    words has one shingle. Null and wordless texts, and rows without an
    id, are each a class of their own (null stays null). Repeated rows of an id fall in one
    class; if their texts differ, every text is compared on its own and the id falls in the
    smallest of their classes. Other columns are left behind; an empty table gives no rows.
    """
    rows = common.texts(docs, id_col, text_col)
    marks = materialize(sketched(rows), "sketches")
    copies = marks.groupBy("copy").agg(F.min_by("sketches", "doc_id").alias("sketches"), F.min("doc_id").alias("doc_id"))
    firsts = materialize(copies, "firsts")
    if not firsts.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _numbered_classes(docs, id_col, text_col, block_rows)
    groups = materialize(candidate_groups(firsts), "groups")

    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / block_rows).cast("int").alias("blocks")
    placed = groups.join(sizes.select("grp", blocks), "grp").join(firsts, "doc_id")
    # A row per block pair that a text belongs to: one for groups of one block.
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            F.least(own, other).alias("low"), F.greatest(own, other).alias("high"),
            F.when(own <= other, F.lit(0)).otherwise(F.lit(1)).alias("side"),
        ),
    )
    placed = placed.select("doc_id", "grp", "sketches", F.explode(cells).alias("cell"))
    placed = placed.select("doc_id", "grp", "sketches", "cell.low", "cell.high", "cell.side")
    wanted = groups.count()
    if wanted <= BROADCAST_ROWS:
        ids = F.broadcast(groups.select("doc_id"))
    else:
        ids = groups.select("doc_id")
    one = rows.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.when(F.col("text").rlike(HAS_WORDS), F.col("text"))).alias("text")
    )
    links = (
        placed.join(one, "doc_id").groupBy("grp", "low", "high")
        .applyInArrow(_group_links, "u long, v long")
    )
    linked = graph.components(materialize(links, "links"))
    classes = firsts.select("copy", "doc_id").join(
        linked.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    ).select("copy", F.coalesce("component", "doc_id").alias("class_id"))
    member = marks.select("doc_id", "copy").distinct().join(classes, "copy").select("doc_id", "class_id")
    member = member.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    full = rows.select("doc_id").join(member, "doc_id", "left")
    return full.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def _numbered_classes(docs: DataFrame, id_col: str, text_col: str, block_rows: int) -> DataFrame:
    """``near_duplicates`` where rows of one id differ: the texts of an id are numbered in order."""
    rows = common.texts(docs, id_col, text_col)
    digest = F.sha2(F.col("text"), 256)
    once = rows.where("doc_id IS NOT NULL").groupBy("doc_id", digest.alias("digest")).agg(F.min("text").alias("text"))
    number = F.monotonically_increasing_id().alias("number")
    numbered = materialize(once.orderBy("doc_id", "digest").select(number, "doc_id", "text"), "numbered")
    found = near_duplicates(numbered.select("number", "text"), "number", "text", block_rows)
    classes = materialize(found.select(F.col("doc_id").alias("number"), "class_id"), "numbered-classes")
    # Numbers follow the ids, so the smallest number of a class is that of its smallest id.
    names = numbered.select(F.col("number").alias("class_id"), F.col("doc_id").alias("name"))
    named = numbered.select("number", "doc_id").join(classes, "number").join(names, "class_id")
    member = named.groupBy("doc_id").agg(F.min("name").alias("class_id"))
    return rows.select("doc_id").join(member, "doc_id", "left").select("doc_id", "class_id")
