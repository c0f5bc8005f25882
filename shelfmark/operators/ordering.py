"""Dense numbering, rankings and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SALTS = 64


def assign_docid(datasets: DataFrame) -> DataFrame:
    """Adds a dense ``docid`` from 1, in the order (first three digits of md5(id), id).

    Ids are unique, so the md5 buckets are even. Rows are numbered inside a bucket in
    parallel; only the bucket sizes (at most 4,096 rows) pass through one task to become
    offsets, and only those offsets are broadcast.
    """
    bucketed = datasets.withColumn("bucket", F.substring(F.md5(F.col("id")), 1, 3))
    sizes = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    within = Window.partitionBy("bucket").orderBy("id")
    return (
        bucketed.withColumn("rn", F.row_number().over(within))
        .join(F.broadcast(offsets), "bucket")
        .withColumn("docid", F.col("rn") + F.col("offset"))
        .drop("bucket", "rn", "offset")
    )


def rank_hits(hits: DataFrame, limit: int = 30, offset: int = 0) -> DataFrame:
    """One page of hits: best score first, then id."""
    return hits.orderBy(F.desc("score"), F.asc("id")).offset(offset).limit(limit)


def rank_hits_batch(hits: DataFrame, deepest: int) -> DataFrame:
    """One page of hits for every query of a batch.

    ``hits`` has ``query_id, id, score, limit, offset``. A query may hold a large share
    of all hits, so the ranking runs in two steps: each of 64 parts of a query keeps the
    rows that could still reach the page, then the survivors of a query are ranked
    together. No hit of the page can be lost, as a row's rank within its part is never
    worse than its rank overall. ``deepest`` is the largest ``offset + limit`` of the batch;
    every map task drops what lies behind it before anything is shuffled.
    """
    best = [F.desc("score"), F.asc("id")]
    part = Window.partitionBy("query_id", F.pmod(F.hash("id"), F.lit(_SALTS))).orderBy(*best)
    whole = Window.partitionBy("query_id").orderBy(*best)
    last = F.col("offset") + F.col("limit")
    kept = hits.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= deepest)
    return (
        kept.filter(F.col("rn") <= last)
        .withColumn("rn", F.row_number().over(whole))
        .filter((F.col("rn") > F.col("offset")) & (F.col("rn") <= last))
    )


def prefetch_order(df: DataFrame, limit: int) -> DataFrame:
    """Most signals, then most downloads, then latest seen; the id settles ties."""
    return df.orderBy(
        F.desc("sig_score"),
        F.desc_nulls_last("downloads"),
        F.desc_nulls_last("last_seen_lm"),
        F.asc("id"),
    ).limit(limit)


def due_jobs(jobs: DataFrame, n: int) -> DataFrame:
    """The ``n`` queued jobs that wait longest."""
    return (
        jobs.filter(F.col("state") == "queued")
        .orderBy(F.asc_nulls_last("enqueued_at"), F.asc("id"))
        .limit(n)
    )
