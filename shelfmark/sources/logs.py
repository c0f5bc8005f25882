"""Append-only logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.schemas import EVENTS, SIGNALS
from shelfmark.sources.conform import conform

_EVENT_KEYS = ("id", "type", "dataset_id", "created_at")


def event_rows(new: DataFrame, as_of: datetime) -> DataFrame:
    """Log rows for raw events: defaults filled in, all further columns packed as JSON."""
    for name in _EVENT_KEYS:
        if name not in new.columns:
            new = new.withColumn(name, F.lit(None).cast("string"))
    rest = [c for c in new.columns if c not in _EVENT_KEYS]
    payload = (
        F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}) if rest else F.lit("{}")
    )
    return conform(
        new.select(
            F.coalesce(F.nullif("id", F.lit("")), F.uuid()).alias("id"),
            F.coalesce("type", F.lit("unknown")).alias("type"),
            "dataset_id",
            payload.alias("payload"),
            F.coalesce(F.col("created_at").cast("timestamp_ntz"), values.at(as_of)).alias(
                "created_at"
            ),
        ),
        EVENTS,
    )


def append_events(events: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    return conform(events, EVENTS).unionByName(event_rows(new, as_of))


def signal_rows(new: DataFrame, as_of: datetime) -> DataFrame:
    """Log rows for raw signals; one row per given id, the first by time.

    The rest of the content settles equal times, so a repeated run keeps the same row.
    """
    rows = conform(new, SIGNALS).withColumn(
        "created_at", F.coalesce("created_at", values.at(as_of))
    )
    named = rows.withColumn("id", F.nullif("id", F.lit("")))
    rest = [c for c in named.columns if c not in ("id", "created_at")]
    first = F.min(F.struct("created_at", F.to_json(F.struct(*rest)).alias("_rest"), *rest)).alias("_first")
    given = named.filter(F.col("id").isNotNull()).groupBy("id").agg(first).select("id", "_first.*")
    given = given.select(*named.columns)
    fresh = named.filter(F.col("id").isNull()).withColumn("id", F.uuid())
    return given.unionByName(fresh)


def append_signals(signals: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """The log with the new signals; an id that is already logged is not added again."""
    rows = signal_rows(new, as_of).join(signals.select("id"), "id", "left_anti")
    return conform(signals, SIGNALS).unionByName(rows.select(*SIGNALS.names))
