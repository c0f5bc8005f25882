"""Incremental catalog ingest: listing → dataset rows, changes, merged tables."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import ingest as ops
from shelfmark.operators import upsert
from shelfmark.session import materialize


def _selected(listing, cursor, limit, backfill_until, gap_safe) -> DataFrame:
    rows = ops.after_cursor(ops.with_lm(listing), cursor)
    if backfill_until is not None:
        rows = rows.filter(F.col("lm") >= values.at(backfill_until))
    return ops.oldest(rows, limit) if gap_safe else ops.newest(rows, limit)


def ingest_listing(
    listing: DataFrame, cursor: DataFrame, as_of: datetime, limit: int | None = None,
    backfill_until: datetime | None = None, source: str = "hf", gap_safe: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(datasets, cursor)``: rows of the listing after the cursor, and the new cursor.

    With a ``limit`` the oldest rows after the cursor are taken, and the cursor moves to the
    last of them, so repeated runs see every row once. ``gap_safe=False`` takes the newest
    rows first; the cursor then passes the older ones, which no later run sees.
    """
    rows = _selected(listing, cursor, limit, backfill_until, gap_safe)
    datasets = ops.listing_to_datasets(rows, as_of, source)
    return datasets, ops.next_cursor(rows.select("lm", "id"), cursor)


def merge_batch(
    datasets: DataFrame, artifacts: DataFrame, batch: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(datasets, artifacts, events)`` after a batch of dataset rows."""
    compared = materialize(upsert.compare_fingerprints(datasets, batch), "compared")
    return (
        upsert.upsert_datasets(datasets, batch),
        upsert.mark_stale(artifacts, upsert.changed_of(compared)),
        upsert.change_events(compared, as_of),
    )


class Catalog(NamedTuple):
    """The tables that a discovery run reads and brings up to date."""

    datasets: DataFrame
    artifacts: DataFrame
    connectors: DataFrame
    docs: DataFrame


class Discovery(NamedTuple):
    """The catalog after a run, its change events, and the ids it touched."""

    catalog: Catalog
    events: DataFrame
    ids: DataFrame


def discover(
    catalog: Catalog, listing: DataFrame, as_of: datetime, limit: int | None = None,
    source: str = "hf", gap_safe: bool = True, window_days: int | None = None,
) -> Discovery:
    """One discovery run: the listing after the source's cursor is merged into the catalog.

    Datasets are upserted, artifacts of changed ones become stale, changes become events,
    the connector's cursor moves on, and search documents are made anew for the touched
    datasets only. With a ``limit``, further runs take up where this one ended. A backfill
    takes only what changed in the last ``window_days`` (1, 3 or 7); the cursor passes the rest.
    """
    mine = catalog.connectors.filter(F.col("source") == source)
    cursor = mine.select("cursor.max_seen.lm", "cursor.max_seen.id")
    until = None if window_days is None else ops.backfill_start(as_of, window_days)
    rows, after = ingest_listing(listing, cursor, as_of, limit, until, source, gap_safe)
    batch = materialize(rows, "discovered")
    datasets, artifacts, events = merge_batch(catalog.datasets, catalog.artifacts, batch, as_of)
    moved = after.filter(F.col("id").isNotNull()).select(
        F.lit(source).alias("source"),
        F.struct(F.struct("lm", "id").alias("max_seen")).alias("cursor"),
        F.lit(None).cast("int").alias("qps_limit"),
        F.lit(None).cast("string").alias("backoff_state"),
    )
    return Discovery(
        Catalog(
            datasets, artifacts,
            upsert.merge_connectors(catalog.connectors, materialize(moved, "cursor")),
            upsert.upsert_docs(catalog.docs, batch),
        ),
        events,
        batch.select("id").distinct(),
    )
