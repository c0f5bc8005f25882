"""Exact top-k inner products, term at a time.

Vectors are whole numbers with one term per component. Queries and candidates meet in the
cells of a grid: candidates are dealt to rows of the grid by a hash of the whole row, queries
to columns, and each side is repeated for the other's cells. Row and column counts follow
from the sizes, so a cell holds at most about ``CELL_CANDIDATES`` by ``CELL_QUERIES`` rows
whatever the input. Within a cell every query row is sparse: for each of its terms it
scatters weight times posting into a dense array of scores, one per candidate. A partition
selection keeps the best k of each block and the blocks of a query are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import importable

CELL_CANDIDATES, CELL_QUERIES = 16_384, 2_048
#: Candidates whose scores are held at once.
BLOCK = 4_096


def quantized(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component, in doubles; null if any cannot take part."""
    values = vector.cast("array<double>")
    whole = F.transform(values, lambda x: F.floor(x * F.lit(float(scale))))
    finite = F.forall(values, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.when(finite, whole)


def _select(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > cut)
        ties = np.flatnonzero(scores == cut)
        room = k - len(above)
        if len(ties) > room:
            ties = ties[np.argpartition(ids[ties], room - 1)[:room]]
        keep = np.concatenate([above, ties])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))]


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, as terms they do not have."""
    lengths = column.combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def score_cell(queries, q_ids, candidates, c_ids, k: int):
    """Rows ``(query position, candidate id, score)``: the best k of every block of candidates."""
    positions, ids, scores = [], [], []
    for low in range(0, len(candidates), BLOCK):
        block = candidates[low : low + BLOCK]
        block_ids = c_ids[low : low + BLOCK]
        postings = [(np.flatnonzero(term), term[term != 0]) for term in block.T]
        for q, row in enumerate(queries):
            dense = np.zeros(len(block), dtype=np.int64)
            for term in np.flatnonzero(row[: len(postings)]):
                where, weight = postings[term]
                if len(where) == len(dense):
                    dense += row[term] * weight
                else:
                    dense[where] += row[term] * weight
            others = np.flatnonzero(block_ids != q_ids[q])
            best = _select(dense[others], block_ids[others], k)
            positions += [q] * len(best)
            ids += block_ids[others][best].tolist()
            scores += dense[others][best].tolist()
    return positions, ids, scores


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10,
    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024,
    cell_candidates: int = CELL_CANDIDATES, cell_queries: int = CELL_QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of every query.

    Candidates are all rows of ``vectors`` but those with the query's own id. Rows whose
    vector is null or holds a null or non-finite component take no part, nor do null ids.
    Missing components count as zero. Repeated rows of one candidate take a rank each.
    Repeated equal query rows are one query; unequal ones of one id are ranked each.
    Components must fit so that the products fit in 64 bits. Other columns are left behind.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    importable(vectors.sparkSession)
    both = []
    for df in (vectors, queries):
        narrow = df.select(
            F.col(f"`{id_col}`").cast("long").alias("vec_id"),
            quantized(F.col(f"`{vector_col}`"), scale).alias("vector"),
        )
        both.append(narrow.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()))
    candidates, asked = both[0], both[1].distinct()
    rows, columns = (
        max(1, -(-df.count() // size)) for df, size in ((candidates, cell_candidates), (asked, cell_queries))
    )
    rows = max(rows, candidates.sparkSession.sparkContext.defaultParallelism * 2 // columns)
    # Repeated equal candidates must not meet in one row of the grid.
    spread = F.xxhash64("vec_id", "vector", F.monotonically_increasing_id())
    left = candidates.withColumn("r", F.pmod(spread, F.lit(rows)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    )
    right = asked.withColumn(
        "c", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(columns)).cast("int")
    ).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    out = pa.schema([("query_id", pa.int64()), ("which", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(some: pa.Table, queries_: pa.Table) -> pa.Table:
        if not some.num_rows or not queries_.num_rows:
            return out.empty_table()
        q_ids = queries_["vec_id"].to_numpy()
        which = queries_["which"].to_numpy()
        positions, ids, scores = score_cell(
            _dense(queries_["vector"]), q_ids, _dense(some["vector"]), some["vec_id"].to_numpy(), k
        )
        at = np.array(positions, dtype=np.int64)
        return pa.table([q_ids[at], which[at], pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], schema=out)

    right = right.withColumn("which", F.xxhash64("vector"))
    best = (
        left.groupBy("r", "c").cogroup(right.groupBy("r", "c"))
        .applyInArrow(cell, "query_id long, which long, vec_id long, score long")
    )
    by_rank = Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
