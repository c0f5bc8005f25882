"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
from collections.abc import Hashable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of every fourth hash class are held out from learning.
HELD_OUT_CLASS, CLASSES = 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver found it.

    Workers on other machines need it installed or shipped with the job.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        parts = [root, known] if known else [root]
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(parts)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text columns alone, as ``doc_id`` and ``text``; a null text is empty.

    All other columns are left behind, so their names never clash with an operator's own.
    """
    importable(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text, mod 4, is 2.

    A null id is held out.
    """
    rest = F.crc32(doc_id.cast("string").cast("binary")) % CLASSES
    return F.coalesce(rest == HELD_OUT_CLASS, F.lit(True))


def bounded_labels(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled ids outside the held-out class.

    ``max_rows`` is the documented bound of a classifier's training sample: where there are
    more labels, those with the smallest hashes of the id stay. Repeated labels of one id
    count once (the largest value); null labels and ids do not count.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    rows = known.count()
    if rows <= max_rows:
        return known
    steps = 1 << 20
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < int(steps * max_rows / rows))


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``doc_id, text, label`` of a sample from ``bounded_labels``, one row of each id.

    The sample's ids are bounded, hence broadcast. Where an id has several rows, its smallest
    text teaches; every task keeps one of an id before rows are moved, so the bound on ids
    is one on rows too.
    """
    rows = texts(docs).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    """The rows of the batches; no more than ``size`` of them are Python objects at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(low, size).columns))
    pa.default_memory_pool().release_unused()


def text_batches(batches: Iterable[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in their order, dealt anew by the bytes of a text column.

    A batch has at most ``size`` bytes, of which every row takes 64 beside its text; a longer
    text is a batch of its own.
    """
    held: list[pa.RecordBatch] = []
    filled = 0
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64) + 64)
        low = before = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(ends, before + size - filled, side="right"))
            if high == low and not held:
                high += 1
            if high > low:
                held.append(batch.slice(low, high - low))
                filled += int(ends[high - 1]) - before
                low, before = high, int(ends[high - 1])
            if low < batch.num_rows:
                yield pa.concat_batches(held)
                held, filled = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield pa.concat_batches(held)
    pa.default_memory_pool().release_unused()


_TABLES: dict[Hashable, dict] = {}


def worker_table(owner: Hashable) -> dict:
    """A table that a Python worker keeps between tasks of one operator.

    Workers serve the stages of a job one after another; the tables of the operator before
    are let go when another one asks, so memory is bounded by the largest one's.
    """
    if owner not in _TABLES:
        _TABLES.clear()
        gc.collect()
        _TABLES[owner] = {}
    return _TABLES[owner]


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows; rows are made as they are asked for."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema
    )
