"""Catalog metrics: counts, percentages, facets and an exact p95."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import joins
from shelfmark.schemas import FACET_FALLBACKS, Settings

_BUCKETS = 16384


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def dataset_state(
    datasets: DataFrame, artifacts: DataFrame, jobs: DataFrame, as_of: datetime
) -> DataFrame:
    """One row per dataset: fresh schema, fresh snips, errors of the last week."""
    return joins.state_join(datasets, artifacts, jobs, as_of).select(
        "id", "has_schema", "has_snips", "recent_errors",
        values.at(as_of).alias("last_refreshed_at"),
    )


def jobs_by_state(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def error_taxonomy(jobs: DataFrame) -> DataFrame:
    classified = jobs.filter(F.col("error_class").isNotNull())
    return classified.groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


def freshness_pct(datasets: DataFrame, as_of: datetime) -> DataFrame:
    fresh = _count(values.since(F.col("indexed_at"), as_of, 1))
    return datasets.agg(_pct(fresh, F.count(F.lit(1))).alias("freshness_pct"))


def thin_readme_pct(datasets: DataFrame) -> DataFrame:
    thin = _count(values.is_thin(F.col("readme_tokens"), F.col("readme_score")))
    return datasets.agg(_pct(thin, F.count(F.lit(1))).alias("thin_readme_pct"))


def schema_coverage(datasets: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Public datasets, those with a schema, the gap and the percentage."""
    flagged = joins.with_schema_flag(
        datasets.filter(F.col("access_class") == "public").select("id"), artifacts
    )
    counts = flagged.agg(
        F.count(F.lit(1)).alias("public_total"), _count(F.col("has_schema") == 1).alias("covered")
    )
    return counts.select(
        "public_total",
        F.col("covered").alias("public_with_schema"),
        F.greatest(F.col("public_total") - F.col("covered"), F.lit(0)).alias(
            "public_no_schema_count"
        ),
        _pct(F.col("covered"), F.col("public_total")).alias("public_with_schema_pct"),
    )


def queue_depth(jobs: DataFrame) -> DataFrame:
    return jobs.agg(_count(F.col("state") == "queued").alias("queue_depth"))


def value_at_rank(numbers: DataFrame, rank: int, low: int, high: int) -> int:
    """The value at a 1-based rank of ``numbers(v)``, whole numbers in ``low..high``.

    Each round counts the values of the remaining range in at most 16,384 buckets, with
    partial aggregation, and goes on inside the bucket that holds the rank. No task sorts
    or holds all values, however they are distributed; the driver sees bucket sizes only.
    """
    while low < high:
        width = (high - low) // _BUCKETS + 1
        bucket = F.expr(f"(v - {low}L) div {width}L").alias("bucket")
        sizes = (
            numbers.filter(F.col("v").between(low, high))
            .groupBy(bucket)
            .agg(F.count(F.lit(1)).alias("n"))
            .collect()
        )
        for size in sorted(sizes):
            if rank <= size["n"]:
                low += size["bucket"] * width
                high = min(high, low + width - 1)
                break
            rank -= size["n"]
    return low


def resolve_p95(jobs: DataFrame) -> DataFrame:
    """Exact p95 of the resolve time in ms over finished jobs; 0.0 without any.

    The value is the one at position ``max(int(n * 0.95), 1)`` of the sorted durations,
    not an interpolation. Durations count in microseconds.
    """
    durations = jobs.filter(
        (F.col("state") == "done")
        & F.col("finished_at").isNotNull()
        & F.col("started_at").isNotNull()
    ).select(F.timestamp_diff("MICROSECOND", "started_at", "finished_at").alias("v"))
    known = durations.agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
    ).first()
    micros = (
        value_at_rank(durations, max(int(known["n"] * 0.95), 1), known["low"], known["high"])
        if known["n"]
        else 0
    )
    return jobs.sparkSession.range(1).select(F.lit(micros / 1000.0).alias("resolve_p95_ms"))


def admin_metrics(
    datasets: DataFrame, artifacts: DataFrame, jobs: DataFrame, as_of: datetime
) -> DataFrame:
    """One row with every metric of the catalog.

    Each table is read by one aggregation; the one-row results are stacked and folded,
    so they meet without a cross join.
    """
    flagged = joins.with_schema_flag(
        datasets.select("id", "access_class", "indexed_at", "readme_tokens", "readme_score"),
        artifacts,
    )
    public = F.col("access_class") == "public"
    catalog = flagged.agg(
        F.count(F.lit(1)).alias("total"),
        _count(values.since(F.col("indexed_at"), as_of, 1)).alias("fresh"),
        _count(values.is_thin(F.col("readme_tokens"), F.col("readme_score"))).alias("thin"),
        _count(public).alias("public_total"),
        _count(public & (F.col("has_schema") == 1)).alias("covered"),
    ).select(
        _pct(F.col("fresh"), F.col("total")).alias("freshness_pct"),
        _pct(F.col("thin"), F.col("total")).alias("thin_readme_pct"),
        F.greatest(F.col("public_total") - F.col("covered"), F.lit(0)).alias(
            "public_no_schema_count"
        ),
        _pct(F.col("covered"), F.col("public_total")).alias("public_with_schema_pct"),
    )
    # Job states and error classes are small vocabularies, so are these maps; both come from
    # one count of the jobs.
    counts = jobs.groupBy("state", "error_class").agg(F.count(F.lit(1)).alias("n"))
    by_state = counts.groupBy("state").agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.max(F.when(F.col("state") == "queued", F.col("n"))), F.lit(0)).alias(
            "queue_depth"
        ),
        F.map_from_entries(
            F.sort_array(
                F.collect_list(
                    F.struct(F.coalesce("state", F.lit("null")).alias("state"), "n")
                )
            )
        ).alias("jobs_by_state"),
    )
    taxonomy = (
        counts.filter(F.col("error_class").isNotNull())
        .groupBy("error_class").agg(F.sum("n").alias("n"))
    )
    by_error = taxonomy.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("error_class", "n")))).alias(
            "error_taxonomy"
        )
    )
    parts = [catalog, resolve_p95(jobs), by_state, by_error]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns]
    )


def search_total(hits: DataFrame) -> DataFrame:
    """Hits before paging."""
    return hits.agg(F.count(F.lit(1)).alias("total"))


def page_stats(hits: DataFrame) -> DataFrame:
    """What a page of hits contains; empty text counts as missing."""
    def filled(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("")) != ""

    return hits.agg(
        F.count(F.lit(1)).alias("page_size"),
        _count(filled("description")).alias("with_description"),
        _count(filled("readme_text")).alias("with_readme"),
        _count(F.col("access_class") == "public").alias("public"),
        _count(filled("access_class") & (F.col("access_class") != "public")).alias("gated"),
        _count(F.col("has_schema") == 1).alias("with_schema"),
    )


def facet_values(hits: DataFrame) -> DataFrame:
    """``(facet, value, n)`` for every value the hits can be filtered by.

    All four facets come from one pass: a hit is exploded into its values and counted
    with partial aggregation. A facet no hit fills offers its fallback values, count 0.
    """
    def single(facet: str, column: str) -> Column:
        value = F.nullif(F.col(column), F.lit(""))
        return F.array(F.struct(F.lit(facet).alias("facet"), value.alias("value")))

    def many(facet: str, column: str) -> Column:
        items = F.coalesce(F.array_distinct(column), F.array().cast("array<string>"))
        return F.transform(
            items, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))
        )

    pairs = F.concat(
        single("license", "license_class"), many("modality", "modalities"),
        many("language", "languages"), single("size", "size_class"),
    )
    counted = (
        hits.select(F.explode(pairs).alias("pair"))
        .select("pair.*")
        .filter(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    offers = [
        F.struct(F.lit(facet).alias("facet"), F.lit(value).alias("value"))
        for facet, offered in FACET_FALLBACKS.items()
        for value in offered
    ]
    fallback = (
        hits.sparkSession.range(1)
        .select(F.explode(F.array(*offers)).alias("offer"))
        .select("offer.*", F.lit(0).cast("bigint").alias("n"))
        .join(counted.select("facet").distinct(), "facet", "left_anti")
    )
    return counted.unionByName(fallback)


def pause_reason(metrics: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``prefetch_paused`` and ``prefetch_reason``, the first reason that holds."""
    reason = (
        F.when(F.col("resolve_p95_ms") > settings.resolve_p95_max_ms, "resolve_slow")
        .when(F.col("queue_depth") > settings.queue_depth_max, "queue_depth")
        .when(F.lit(not settings.prefetch_enabled), "prefetch_disabled")
    )
    return metrics.withColumn("prefetch_reason", reason).withColumn(
        "prefetch_paused", F.col("prefetch_reason").isNotNull()
    )
