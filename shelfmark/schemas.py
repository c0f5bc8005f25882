"""Table schemas and settings of the catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

_S, _I, _L = T.StringType(), T.IntegerType(), T.LongType()
_TS, _LIST = T.TimestampNTZType(), T.ArrayType(T.StringType())


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


DATASETS = _table(
    ("id", _S), ("source", _S), ("ns_local_id", _S),
    ("title", _S), ("description", _S), ("readme_text", _S),
    ("tags", _LIST), ("modalities", _LIST),
    ("license_class", _S), ("access_class", _S), ("size_class", _S),
    ("languages", _LIST), ("last_seen_lm", _TS),
    ("readme_sha256", _S), ("card_sha256", _S), ("fingerprint", _S),
    ("indexed_at", _TS), ("readme_tokens", _I), ("readme_score", T.DoubleType()),
    ("eligibility_flags", _LIST), ("quality_signals", _S), ("schema_hint", _S),
)

ARTIFACTS = _table(
    ("dataset_id", _S), ("kind", _S), ("payload", _S),
    ("created_at", _TS), ("stale", T.BooleanType()),
)

JOBS = _table(
    ("id", _S), ("dataset_id", _S), ("kind", _S), ("state", _S),
    ("attempts", _I), ("error_class", _S), ("error_detail", _S),
    ("budget_ms", _I), ("row_cap", _I),
    ("enqueued_at", _TS), ("started_at", _TS), ("finished_at", _TS),
)

EVENTS = _table(
    ("id", _S), ("type", _S), ("dataset_id", _S), ("payload", _S), ("created_at", _TS),
)

SIGNALS = _table(
    ("id", _S), ("session_id", _S), ("user_id", _S), ("event", _S),
    ("dataset_id", _S), ("query", _S), ("rank", _I), ("created_at", _TS),
)

CURSOR = _table(("lm", _TS), ("id", _S))

CONNECTORS = _table(
    ("source", _S), ("cursor", T.StructType([T.StructField("max_seen", CURSOR)])),
    ("qps_limit", _I), ("backoff_state", _S),
)

DATASET_STATE = _table(
    ("id", _S), ("has_schema", _I), ("has_snips", _I), ("recent_errors", _I),
    ("last_refreshed_at", _TS),
)

SEARCH_DOCS = _table(("dataset_id", _S), ("content", _S))

LISTING = _table(
    ("id", _S), ("last_modified", _S), ("tags", _LIST), ("license", _S),
    ("private", T.BooleanType()), ("downloads", _L), ("likes", _L),
    ("gated", T.BooleanType()), ("card_title", _S), ("has_card", T.BooleanType()),
)

TABLES = {
    "datasets": DATASETS, "artifacts": ARTIFACTS, "jobs": JOBS, "events": EVENTS,
    "signals": SIGNALS, "connectors": CONNECTORS, "dataset_state": DATASET_STATE,
    "search_docs": SEARCH_DOCS,
}

# The size classes in rising order, and how each one is shown.
SIZE_CLASSES = (
    "n<1K", "1K<n<10K", "10K<n<100K", "100K<n<1M", "1M<n<10M", "10M<n<100M", "n>100M",
)
SIZE_LABELS = {
    "n<1K": "< 1K rows",
    "1K<n<10K": "1K–10K rows",
    "10K<n<100K": "10K–100K rows",
    "100K<n<1M": "100K–1M rows",
    "1M<n<10M": "1M–10M rows",
    "10M<n<100M": "10M–100M rows",
    "n>100M": "> 100M rows",
}

# What a filter offers when the hits carry no value of that facet.
FACET_FALLBACKS = {
    "license": ("apache-2.0", "mit", "bsd-3-clause", "cc-by-4.0", "cc-by-sa-4.0", "cc0-1.0"),
    "modality": ("text", "image", "audio", "tabular"),
    "language": ("en", "de", "fr", "es", "zh"),
    "size": SIZE_CLASSES,
}


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds; the defaults are fixed values."""

    resolve_budget_ms: int = 1500
    resolve_row_cap: int = 200
    prefetch_enabled: bool = True
    resolve_p95_max_ms: int = 3000
    queue_depth_max: int = 500
    lease_timeout_sec: float = 30.0
    max_size_class: str | None = None
    license_allowlist: tuple[str, ...] = (
        "apache-2.0", "mit", "bsd-3-clause", "bsd-2-clause", "cc-by-4.0", "cc-by-sa-4.0",
        "cc0-1.0", "openrail", "cdla-permissive-2.0", "odc-by", "odc-odbl",
    )
