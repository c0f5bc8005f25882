"""Incremental ingest of a catalog listing."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text, values
from shelfmark.schemas import DATASETS
from shelfmark.sources.conform import conform

BACKFILL_DAYS = (1, 3, 7)  # fixed values


def with_lm(listing: DataFrame) -> DataFrame:
    """Adds ``lm``, the parsed time; rows without a valid one are dropped."""
    kind = dict(listing.dtypes)["last_modified"]
    parsed = (
        values.parse_lm(F.col("last_modified"))
        if kind == "string"
        else F.col("last_modified").cast("timestamp_ntz")
    )
    return listing.withColumn("lm", parsed).filter(F.col("lm").isNotNull())


def after_cursor(listing: DataFrame, cursor: tuple[datetime, str] | DataFrame | None) -> DataFrame:
    """Rows of ``listing(lm, id)`` strictly after the cursor, by time and then id.

    The cursor is a ``(time, id)`` pair, a one-row frame ``(lm, id)``, or None for all.
    """
    if cursor is None:
        return listing
    if isinstance(cursor, DataFrame):
        seen = cursor.select(F.struct("lm", "id").alias("seen")).scalar()
        return (
            listing.withColumn("_seen", seen)
            .filter(_is_after(F.col("_seen.lm"), F.col("_seen.id")))
            .drop("_seen")
        )
    return listing.filter(_is_after(values.at(cursor[0]), F.lit(cursor[1])))


def _is_after(lm: Column, id_: Column) -> Column:
    return F.col("lm").isNotNull() & (F.struct("lm", "id") > F.struct(lm.alias("lm"), id_.alias("id")))


def backfill_start(as_of: datetime, window_days: int) -> datetime:
    """Where a backfill of the last 1, 3 or 7 days begins."""
    if window_days not in BACKFILL_DAYS:
        raise ValueError(f"window_days must be one of {BACKFILL_DAYS}")
    return as_of - timedelta(days=window_days)


def backfill(listing: DataFrame, as_of: datetime, window_days: int) -> DataFrame:
    """Rows of the last 1, 3 or 7 days."""
    backfill_start(as_of, window_days)
    return listing.filter(values.since(F.col("lm"), as_of, window_days))


def newest(listing: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` rows."""
    if not limit:
        return listing
    return listing.orderBy(F.desc("lm"), F.desc("id")).limit(limit)


def oldest(listing: DataFrame, limit: int | None) -> DataFrame:
    """The oldest ``limit`` rows: those a run must take first, so that none is left behind."""
    if not limit:
        return listing
    return listing.orderBy(F.asc("lm"), F.asc("id")).limit(limit)


def listing_to_datasets(listing: DataFrame, as_of: datetime, source: str = "hf") -> DataFrame:
    """Dataset rows for listing rows ``(id, lm, tags, license, private, …)``.

    The title is the one on the card where the row has a card, else the id.
    """
    local_id = values.ns_local_id(F.col("id"))
    license_class = F.nullif(F.col("license"), F.lit(""))
    nothing = F.lit(None).cast("string")
    quality = F.to_json(
        F.struct("downloads", "likes", "gated"), {"ignoreNullFields": "false"}
    )
    rows = listing.select(
        "id", F.lit(source).alias("source"), local_id.alias("ns_local_id"),
        F.when(F.col("has_card"), F.col("card_title")).otherwise(F.col("id")).alias("title"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        license_class.alias("license_class"),
        values.access_class(F.col("private")).alias("access_class"),
        F.col("lm").alias("last_seen_lm"),
        text.fingerprint(
            F.lit(source), local_id, nothing, values.iso_format(F.col("lm")), nothing,
            license_class,
        ).alias("fingerprint"),
        values.at(as_of).alias("indexed_at"),
        F.lit(0).alias("readme_tokens"), F.lit(0.0).alias("readme_score"),
        quality.alias("quality_signals"),
    )
    return conform(rows, DATASETS)


def next_cursor(processed: DataFrame, old: DataFrame) -> DataFrame:
    """The cursor ``(lm, id)`` after a run: the largest processed, else the old one."""
    top = processed.agg(F.max(F.struct("lm", "id")).alias("top"))
    return (
        top.select("top.lm", "top.id", F.lit(1).alias("rank"))
        .unionByName(old.select("lm", "id").withColumn("rank", F.lit(0)))
        .filter(F.col("id").isNotNull())
        .agg(F.max_by(F.struct("lm", "id"), "rank").alias("best"))
        .select("best.lm", "best.id")
    )
