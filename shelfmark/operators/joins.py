"""Joins of the catalog tables.

Every side that can hold many rows per dataset is reduced to one row per dataset
before it is joined, so no join multiplies rows and a dataset with a large share of
the log is absorbed by the partial aggregation in front of the shuffle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import filters


def distinct_schema_ids(artifacts: DataFrame) -> DataFrame:
    """Ids that have a fresh schema artifact."""
    return filters.fresh_artifacts(artifacts).select("dataset_id").distinct()


def join_docs(docs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Search documents with the dataset they describe."""
    return docs.join(datasets, docs["dataset_id"] == datasets["id"], "inner").drop("dataset_id")


def with_schema_flag(datasets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds ``has_schema`` 0/1."""
    fresh = distinct_schema_ids(artifacts).select(
        F.col("dataset_id").alias("id"), F.lit(1).alias("has_schema")
    )
    return datasets.join(fresh, "id", "left").withColumn(
        "has_schema", F.coalesce("has_schema", F.lit(0))
    )


def artifact_flags(artifacts: DataFrame) -> DataFrame:
    """One row per dataset: does it hold a fresh schema, fresh snips."""
    def any_fresh(kind: str):
        fresh = (F.col("kind") == kind) & (F.col("stale") == F.lit(False))
        return F.max(F.when(fresh, 1).otherwise(0)).alias(f"has_{kind}")

    return artifacts.groupBy(F.col("dataset_id").alias("id")).agg(
        any_fresh("schema"), any_fresh("snips"), F.count(F.lit(1)).alias("artifacts")
    )


def recent_job_flags(jobs: DataFrame, as_of: datetime) -> DataFrame:
    """One row per dataset with a job in the last 7 days: did one fail."""
    recent = jobs.filter(values.since(F.col("enqueued_at"), as_of, 7, strict=True))
    return recent.groupBy(F.col("dataset_id").alias("id")).agg(
        F.max(F.when(F.col("state") == "error", 1).otherwise(0)).alias("recent_errors"),
        F.count(F.lit(1)).alias("recent_jobs"),
    )


def state_join(
    datasets: DataFrame, artifacts: DataFrame, jobs: DataFrame, as_of: datetime
) -> DataFrame:
    """Datasets with the flags of their artifacts and of their recent jobs.

    Both sides are aggregated first: the flags equal those over the product of
    artifacts and jobs, and the product is never built.
    """
    return (
        datasets.select("id")
        .join(artifact_flags(artifacts), "id", "left")
        .join(recent_job_flags(jobs, as_of), "id", "left")
        .na.fill(0)
    )


def without_schema(datasets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Datasets that have no fresh schema artifact."""
    fresh = filters.fresh_artifacts(artifacts).select(F.col("dataset_id").alias("id"))
    return datasets.join(fresh, "id", "left_anti")


def covered_public(datasets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Public datasets that have a fresh schema artifact."""
    fresh = filters.fresh_artifacts(artifacts).select(F.col("dataset_id").alias("id"))
    return datasets.filter(F.col("access_class") == "public").join(fresh, "id", "left_semi")


def signal_popularity(signals: DataFrame, as_of: datetime) -> DataFrame:
    """Signals per dataset in the last 7 days."""
    recent = signals.filter(values.since(F.col("created_at"), as_of, 7))
    return recent.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("sig_score"))


def with_signal_score(datasets: DataFrame, signals: DataFrame, as_of: datetime) -> DataFrame:
    """Adds ``sig_score``, 0 without signals."""
    score = signal_popularity(signals, as_of).withColumnRenamed("dataset_id", "id")
    return datasets.join(score, "id", "left").withColumn(
        "sig_score", F.coalesce("sig_score", F.lit(0).cast("bigint"))
    )


def request_join(requests: DataFrame, artifacts: DataFrame, datasets: DataFrame) -> DataFrame:
    """Requests with the stored artifact of the asked kind and with the dataset, if any.

    Requests may hit one dataset very often; the catalog sides are unique per key, so a
    hot dataset splits under adaptive skew handling without changing the result.
    """
    stored = artifacts.select("dataset_id", "kind", "stale").withColumn(
        "has_artifact", F.lit(True)
    )
    known = datasets.select(
        F.col("id").alias("dataset_id"), "access_class", "license_class", "size_class",
        F.lit(True).alias("known"),
    )
    return requests.join(stored, ["dataset_id", "kind"], "left").join(
        known, "dataset_id", "left"
    )
