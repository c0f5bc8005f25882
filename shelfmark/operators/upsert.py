"""Keyed merges and change detection.

A merge keeps the stored rows whose key is not in the batch (anti join) and adds the
batch. Only the keys of the batch meet the stored table. Upserts measure them, so a small
batch never makes the wide stored rows move; a large one moves them once.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import values
from shelfmark.operators.search import build_search_docs, is_short
from shelfmark.schemas import ARTIFACTS, DATASETS, JOBS
from shelfmark.session import materialize
from shelfmark.sources.conform import conform


# What tells the last row of a key, where the batch has it.
_LATEST = ("batch_pos", "last_seen_lm", "fingerprint", "created_at", "enqueued_at")


def last_per_key(batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the last in batch order.

    The order is ``batch_pos``; where that is missing or equal, the latest by time and
    fingerprint, and a hash of the whole row settles the rest. Each map task passes on one
    row per key only, so a key that fills the batch stays cheap.
    """
    known = [F.desc(c) for c in _LATEST if c in batch.columns]
    latest = Window.partitionBy(*keys).orderBy(*known, F.xxhash64(*batch.columns))
    return (
        batch.withColumn("_rn", F.row_number().over(latest))
        .filter(F.col("_rn") == 1)
        .drop("_rn", "batch_pos")
    )


def merge_rows(
    old: DataFrame, new: DataFrame, keys: list[str], schema: T.StructType
) -> DataFrame:
    """Old rows whose key is not among the new ones, and the last new row of each key."""
    latest = conform(last_per_key(new, keys), schema)
    kept = old.join(latest.select(*keys), keys, "left_anti")
    return conform(kept, schema).unionByName(latest)


def _upsert(old: DataFrame, new: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """``merge_rows`` with the batch stored once and its keys measured.

    Few keys are broadcast, so the wide stored rows stay where they are; many are joined by
    a shuffle.
    """
    latest = materialize(conform(last_per_key(new, keys), schema), "batch")
    few = latest.select(*keys)
    kept = old.join(F.broadcast(few) if is_short(few) else few, keys, "left_anti")
    return conform(kept, schema).unionByName(latest)


def upsert_datasets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or overwrite whole dataset rows; NULLs of the new row overwrite too."""
    return _upsert(old, new, ["id"], DATASETS)


def upsert_artifacts(old: DataFrame, new: DataFrame) -> DataFrame:
    return _upsert(old, new, ["dataset_id", "kind"], ARTIFACTS)


def upsert_jobs(old: DataFrame, new: DataFrame) -> DataFrame:
    return _upsert(old, new, ["id"], JOBS)


def upsert_docs(docs: DataFrame, batch: DataFrame) -> DataFrame:
    """Search documents after a batch of dataset rows: only the batch's are made anew."""
    fresh = materialize(build_search_docs(last_per_key(batch, ["id"])), "documents")
    few = fresh.select("dataset_id")
    kept = docs.join(F.broadcast(few) if is_short(few) else few, "dataset_id", "left_anti")
    return kept.unionByName(fresh)


def cut_to(old: DataFrame, ids: DataFrame) -> DataFrame:
    """Id and fingerprint of the stored rows that a batch has too.

    Few ids are broadcast, so stored rows are read where they are and not moved; many meet them
    in a shuffle of these two columns.
    """
    few = F.broadcast(ids) if is_short(ids) else ids
    return old.select("id", F.col("fingerprint").alias("fingerprint_old")).join(few, "id", "left_semi")


def compare_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every batch row with the stored fingerprint and the event type it causes, if any.

    An unknown id and a stored NULL both count as discovered; a stored value that
    differs, also from NULL, as changed. Repeats in the batch are each compared with the
    stored value.
    """
    ids = materialize(new.select("id").distinct(), "batch-ids")
    stored = materialize(cut_to(old, ids), "stored")
    position = [c for c in ("batch_pos",) if c in new.columns]
    batch = new.select("id", F.col("fingerprint").alias("fingerprint_new"), *position)
    event = F.when(F.col("fingerprint_old").isNull(), "dataset.discovered").when(
        ~F.equal_null("fingerprint_old", "fingerprint_new"), "dataset.changed"
    )
    return batch.join(stored, "id", "left").withColumn("type", event)


def detect_changes(old: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """Change events ``(id, type, dataset_id, payload, created_at)`` of a batch.

    Event ids are a hash of what happened, so a repeated run logs the same ids.
    """
    return change_events(compare_fingerprints(old, new), as_of)


def change_events(compared: DataFrame, as_of: datetime) -> DataFrame:
    """The events of ``compare_fingerprints``."""
    events = compared.filter(F.col("type").isNotNull())
    keep_nulls = {"ignoreNullFields": "false"}
    payload = F.when(
        F.col("type") == "dataset.changed",
        F.to_json(F.struct("fingerprint_old", "fingerprint_new"), keep_nulls),
    ).otherwise(F.to_json(F.struct("fingerprint_new"), keep_nulls))
    position = F.col("batch_pos").cast("string") if "batch_pos" in events.columns else F.lit("")
    key = F.concat_ws("|", "type", "id", payload, position, values.iso_format(values.at(as_of)))
    return events.select(
        F.sha2(key, 256).alias("id"), "type", F.col("id").alias("dataset_id"),
        payload.alias("payload"), values.at(as_of).alias("created_at"),
    )


def changed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids whose artifacts a batch makes stale.

    A missing new fingerprint counts as empty text here, so a stored empty one is no change.
    """
    return changed_of(compare_fingerprints(old, new))


def changed_of(compared: DataFrame) -> DataFrame:
    """The ids of ``compare_fingerprints`` whose artifacts become stale."""
    moved = F.col("fingerprint_old") != F.coalesce("fingerprint_new", F.lit(""))
    return compared.filter(F.col("type") == "dataset.changed").filter(moved).select("id").distinct()


def mark_stale(artifacts: DataFrame, changed: DataFrame) -> DataFrame:
    """All artifacts of the datasets in ``changed(id)`` become stale."""
    hit = materialize(changed.select(F.col("id").alias("dataset_id")).distinct(), "changed")
    hit = hit.withColumn("_hit", F.lit(True))
    return (
        artifacts.join(F.broadcast(hit) if is_short(hit) else hit, "dataset_id", "left")
        .withColumn("stale", F.when(F.col("_hit"), True).otherwise(F.col("stale")))
        .drop("_hit")
    )


def merge_connectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Connector state by source: the cursor is replaced, limits keep their old value
    when the new one is NULL."""
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, F.col("o.source") == F.col("n.source"), "full")
    return joined.select(
        F.coalesce("n.source", "o.source").alias("source"),
        F.when(F.col("n._new"), F.col("n.cursor")).otherwise(F.col("o.cursor")).alias("cursor"),
        F.coalesce("n.qps_limit", "o.qps_limit").alias("qps_limit"),
        F.coalesce("n.backoff_state", "o.backoff_state").alias("backoff_state"),
    )
