"""Toxicity by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A text's features are the hashes of its words, of neighbouring words and of words with one
word between them, each counted once. Learning keeps per-coordinate sums (z, n): the rate of
a coordinate falls with the gradients it has seen, and L1 keeps the weights of uninformative
coordinates at exactly zero. The training sample is bounded and split into shards by id; each
shard is learnt in one task, and shards are averaged by coordinate with a Spark aggregation.
The weights that are left are few, at most 2^BITS, so they are broadcast; scoring is one pass
over whole texts without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import common

BITS = 20
#: Bound of the training sample, in labelled rows, and of the rows that one task learns from.
MAX_ROWS, SHARD_ROWS = 20_000, 10_000
THRESHOLD = 0.3
#: Word hashes kept in a worker.
KEPT = 300_000

_WORD = re.compile(r"[^\W_]+")
_MASK = np.uint64((1 << BITS) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.05
    epochs: int = 12


def _hash(word: str, table: dict[str, int]) -> int:
    value = zlib.crc32(word.encode())
    if len(table) < KEPT:
        table[word] = value
    return value


def features(text: str) -> np.ndarray:
    """Distinct coordinates of a text's words, word pairs and pairs with a gap of one word."""
    words = _WORD.findall(text.lower())
    table = common.worker_table("toxicity")
    known = table.get
    h = np.array([known(w) or _hash(w, table) for w in words], dtype=np.uint64)
    with np.errstate(over="ignore"):
        grams = [h * _ODD[0]]
        if len(h) > 1:
            grams.append((h[:-1] * _ODD[1]) ^ (h[1:] * _ODD[2]))
        if len(h) > 2:
            grams.append((h[:-2] * _ODD[2]) ^ (h[2:] * _ODD[0]) ^ _ODD[1])
        mixed = np.concatenate(grams) * _ODD[1]
    return np.unique(((mixed >> np.uint64(40)) & _MASK).astype(np.int32))


class Learner:
    """FTRL-proximal state; coordinate ``1 << BITS`` is the intercept, without L1."""

    def __init__(self, settings: Ftrl):
        self.s = settings
        self.z = np.zeros((1 << BITS) + 1)
        self.n = np.zeros((1 << BITS) + 1)
        self.l1 = np.full((1 << BITS) + 1, settings.l1)
        self.l1[-1] = 0.0

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        rate = (s.beta + np.sqrt(n)) / s.alpha + s.l2
        return np.where(np.abs(z) <= self.l1[at], 0.0, (np.sign(z) * self.l1[at] - z) / rate)

    def learn(self, coordinates: np.ndarray, label: int) -> None:
        at = np.append(coordinates, 1 << BITS)
        w = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.s.alpha * w
        self.n[at] = n + gradient**2


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic",
    settings: Ftrl = Ftrl(), max_rows: int = MAX_ROWS, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``coordinate, weight`` of the non-zero weights, from labels outside the held-out class.

    Without labelled rows, or with one class only, there are no weights but an intercept at
    most, and every text scores alike.
    """
    known = common.bounded_labels(labels, label, max_rows)
    shards = max(1, -(-known.count() // shard_rows))
    sample = common.labelled_texts(docs, known)
    shard = F.pmod(F.hash("doc_id"), F.lit(shards)).alias("shard")

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.take(np.lexsort((rows["text"].to_numpy(), rows["doc_id"].to_numpy())))
        order = np.random.default_rng(7).permutation(rows.num_rows)
        coordinates = [features(t) for t in rows["text"].to_pylist()]
        targets = rows["label"].to_pylist()
        model = Learner(settings)
        for _ in range(settings.epochs):
            for i in order:
                model.learn(coordinates[i], targets[i])
        w = model.weights()
        at = np.flatnonzero(w)
        return pa.table({"coordinate": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    learnt = (
        sample.select("doc_id", "text", "label", shard).groupBy("shard")
        .applyInArrow(learn, "coordinate long, weight double")
    )
    return learnt.groupBy("coordinate").agg((F.sum("weight") / shards).alias("weight"))


class Scorer:
    """Probabilities of texts by a model's weights, which a task spreads out once."""

    def __init__(self, places: np.ndarray, values: np.ndarray):
        self.w = np.zeros((1 << BITS) + 1)
        self.w[places] = values

    def __call__(self, text: str) -> float:
        total = self.w[features(text)].sum() + self.w[-1]
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def _shared(spark: SparkSession, weights: DataFrame) -> Broadcast:
    rows = weights.collect()  # at most 2^BITS + 1, by the coordinates' range
    rows.sort(key=lambda r: r["coordinate"])
    return spark.sparkContext.broadcast(
        (np.array([r["coordinate"] for r in rows], dtype=np.int64), np.array([r["weight"] for r in rows]))
    )


def score(
    docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, score`` of every row: the probability that the label is 1.

    A null or empty text has the intercept's score. Null ids stay, repeated rows are scored
    each, other columns are left behind, an empty table gives no rows.
    """
    shared = _shared(docs.sparkSession, weights)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        scored = Scorer(*shared.value)
        made = ((doc_id, scored(text)) for doc_id, text in common.rows_of(batches))
        yield from common.batched(made, schema)

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def drop_toxic(
    docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    A null text is scored as an empty one.
    """
    common.importable(docs.sparkSession)
    shared = _shared(docs.sparkSession, weights)

    def run(batches):
        scored = Scorer(*shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                yield part.filter(pa.array([scored(t or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score(docs, train(docs, labels)).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
