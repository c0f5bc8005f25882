"""Prefetch: which thin public datasets to resolve ahead of demand."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import filters, joins, metrics, ordering, upsert
from shelfmark.schemas import JOBS, Settings
from shelfmark.sources.conform import conform


def ranked_candidates(
    datasets: DataFrame, artifacts: DataFrame, signals: DataFrame, as_of: datetime
) -> DataFrame:
    """Thin public datasets without a fresh schema, with what they are ranked by.

    The catalog is filtered before it meets artifacts and signals, so the joins carry
    only the narrow rows of possible candidates.
    """
    thin = filters.thin_datasets(datasets.filter(F.col("access_class") == "public")).select(
        "id", "last_seen_lm",
        values.json_bigint(F.col("quality_signals"), "downloads").alias("downloads"),
    )
    return joins.with_signal_score(joins.without_schema(thin, artifacts), signals, as_of)


def prefetch_candidates(
    datasets: DataFrame, artifacts: DataFrame, signals: DataFrame, as_of: datetime, limit: int
) -> DataFrame:
    candidates = ranked_candidates(datasets, artifacts, signals, as_of)
    return ordering.prefetch_order(candidates, limit)


def prefetch_jobs(
    candidates: DataFrame, metrics_row: DataFrame, jobs: DataFrame, as_of: datetime,
    settings: Settings = Settings(),
) -> DataFrame:
    """The job table with a queued job per candidate; unchanged while paused.

    A job that was prefetched before is reset.
    """
    paused = metrics.pause_reason(metrics_row, settings).select("prefetch_paused").scalar()
    new = candidates.filter(~paused).select(
        F.concat(F.lit("prefetch-"), "id").alias("id"), F.col("id").alias("dataset_id"),
        F.lit("schema").alias("kind"), F.lit("queued").alias("state"),
        F.lit(0).alias("attempts"), F.lit(settings.resolve_budget_ms).alias("budget_ms"),
        F.lit(settings.resolve_row_cap).alias("row_cap"), values.at(as_of).alias("enqueued_at"),
    )
    return upsert.upsert_jobs(jobs, conform(new, JOBS))
