"""Document quality from random-indexing word vectors and a small network.

1. Every word has a bucket and a sparse ternary index vector, both from its hash. A word's
   vector is the sum of the index vectors of the words around it, over all texts: each task
   adds up a matrix of fixed size and the matrices meet in an aggregation by bucket.
2. A text is pooled: the mean of its words' vectors and their spread.
3. A two-layer network learns the label from a bounded sample of pooled rows, and a
   temperature, found on a part of the sample that the network has not seen, calibrates it.

The word matrix and the network have fixed sizes and are broadcast.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import common

BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 14, 64, 2, 2
#: Bound of the training sample, in labelled rows.
MAX_ROWS = 12_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
THRESHOLD = 0.7
#: Word hashes kept in a worker.
KEPT = 300_000
#: Characters of text that are handled at once.
_BLOCK = 1_000_000


def _hash(word: str, table: dict[str, int]) -> int:
    value = zlib.crc32(word.encode())
    if len(table) < KEPT:
        table[word] = value
    return value


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of a text, parted by white space, in order."""
    table = common.worker_table("quality")
    known = table.get
    return np.array([known(w) or _hash(w, table) for w in text.split()], dtype=np.uint64)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def _index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of index vectors, ``NONZERO`` a word."""
    with np.errstate(over="ignore"):
        seeds = hashes[:, None] * np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)[:NONZERO]
        seeds ^= seeds >> np.uint64(29)
        seeds *= np.uint64(0xBF58476D1CE4E5B9)
    return ((seeds >> np.uint64(40)) % np.uint64(DIMENSIONS)).astype(np.int64), (
        1 - 2 * ((seeds >> np.uint64(20)) & np.uint64(1)).astype(np.int64)
    )


def add_contexts(matrix: np.ndarray, documents: list[np.ndarray]) -> None:
    """Add the index vectors of each word's neighbours to its row; texts do not touch."""
    h = np.concatenate(documents) if documents else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    rows, (places, signs) = _bucket(h), _index(h)
    for gap in range(1, WINDOW + 1):
        together = np.flatnonzero(owner[gap:] == owner[:-gap])
        for word, other in ((together, together + gap), (together + gap, together)):
            flat = rows[word][:, None] * DIMENSIONS + places[other]
            np.add.at(matrix, flat.ravel(), signs[other].ravel())


def _groups(batches):
    """Texts in groups of about ``_BLOCK`` characters."""
    held, size = [], 0
    for doc_id, text in common.rows_of(batches):
        held.append((doc_id, text))
        size += len(text)
        if size >= _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_vectors(docs: DataFrame) -> DataFrame:
    """``bucket, vector`` from the contexts of all words of all texts (``doc_id, text``)."""
    schema = pa.schema([("bucket", pa.int64()), ("vector", pa.list_(pa.int64()))])

    def run(batches):
        matrix = np.zeros(BUCKETS * DIMENSIONS, dtype=np.int64)
        for group in _groups(batches):
            add_contexts(matrix, [word_hashes(t) for _, t in group])
        matrix = matrix.reshape(BUCKETS, DIMENSIONS)
        some = np.flatnonzero(matrix.any(axis=1))
        yield from common.batched(((int(b), matrix[b]) for b in some), schema)

    parts = docs.mapInArrow(run, "bucket long, vector array<long>")
    sums = [F.sum(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(DIMENSIONS)]
    summed = parts.groupBy("bucket").agg(*sums)
    return summed.select("bucket", F.array(*[f"v{i}" for i in range(DIMENSIONS)]).alias("vector"))


def unit_matrix(vectors: DataFrame) -> np.ndarray:
    """The word vectors as rows of length 1; buckets without contexts stay zero."""
    rows = vectors.collect()  # at most BUCKETS
    matrix = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
    for r in rows:
        v = np.array(r["vector"], dtype=np.float64)
        matrix[r["bucket"]] = v / max(np.linalg.norm(v), 1e-9)
    return matrix


def pool(matrix: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors of a text's words; zeros without words."""
    if not len(hashes):
        return np.zeros(2 * DIMENSIONS, dtype=np.float32)
    v = matrix[_bucket(hashes)]
    return np.concatenate([v.mean(axis=0), v.std(axis=0)])


@dataclass(frozen=True)
class Network:
    centre: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.centre) / self.spread @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> Network:
    """Adam on the cross-entropy of two layers, then a temperature on an unseen fifth.

    Without rows the network gives one half; with one class only, a probability near it.
    """
    rng = np.random.default_rng(seed)
    if not len(x):
        width = 2 * DIMENSIONS
        return Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    order = rng.permutation(len(x))
    kept, aside = order[len(x) // 5 :], order[: len(x) // 5]
    centre, spread = x[kept].mean(axis=0), x[kept].std(axis=0) + 1e-4
    z, target = (x[kept] - centre) / spread, y[kept].astype(np.float64)
    rate = np.clip(target.mean(), 0.01, 0.99)
    p = [rng.normal(0, (2 / z.shape[1]) ** 0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(rate / (1 - rate)))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(z))
        for low in range(0, len(z), 128):
            rows = shuffled[low : low + 128]
            before = z[rows] @ p[0] + p[1]
            hidden = np.maximum(before, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -35, 35))) - target[rows]) / len(rows)
            back = np.outer(error, p[2]) * (before > 0)
            gradients = [z[rows].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], error.sum()]
            step += 1
            for i, g in enumerate(gradients):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, spread, p[0], p[1], p[2], float(p[3]))
    if not len(aside):
        return net
    logits, truth = net.logits(x[aside]), y[aside]

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))

    best = min(np.geomspace(0.25, 8, 61), key=loss)
    return Network(centre, spread, p[0], p[1], p[2], float(p[3]), float(best))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS):
    """The unit word matrix and the network, from labels outside the held-out class."""
    rows = common.texts(docs)
    matrix = unit_matrix(word_vectors(rows))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("pooled", pa.binary())])

    def run(batches):
        made = (
            (doc_id, label, pool(shared.value, word_hashes(text)).astype("<f4").tobytes())
            for doc_id, text, label in common.rows_of(batches)
        )
        yield from common.batched(made, schema)

    sample = common.labelled_texts(docs, common.bounded_labels(labels, label, max_rows))
    pooled = sample.mapInArrow(run, "doc_id long, label long, pooled binary").collect()
    pooled.sort(key=lambda r: (r["doc_id"], bytes(r["pooled"])))
    x = np.array([np.frombuffer(r["pooled"], dtype="<f4") for r in pooled], dtype=np.float64)
    return shared, fit(x.reshape(len(pooled), 2 * DIMENSIONS), np.array([r["label"] for r in pooled]))


def score(docs: DataFrame, matrix, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row: the calibrated probability that the label is 1.

    A null or empty text is pooled to zeros and scored. Null ids stay, repeated rows are
    scored each, other columns are left behind, an empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for group in _groups(batches):
            x = np.array([pool(matrix.value, word_hashes(t)) for _, t in group])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in group], pa.int64()), pa.array(shared.value.probabilities(x), pa.float64())],
                schema=schema,
            )

    return common.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return score(docs, *train(docs, labels)).select(
        "doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
