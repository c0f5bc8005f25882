"""Catalog files: ``{"datasets": [...], "artifacts": [...]}`` as JSON, or record files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text, values
from shelfmark.schemas import ARTIFACTS, DATASETS, LISTING
from shelfmark.sources.conform import conform

# Nested objects are read as their JSON text.
_DATASET = """
  id string, source string, ns_local_id string, title string, description string,
  readme_text string, tags array<string>, modalities array<string>, license_class string,
  access_class string, size_class string, languages array<string>, quality_signals string
"""
_ARTIFACT = "dataset_id string, kind string, payload string"
_CATALOG = f"datasets array<struct<{_DATASET}>>, artifacts array<struct<{_ARTIFACT}>>"


def dataset_records(records: DataFrame, indexed_at: datetime) -> DataFrame:
    """Dataset rows for catalog records: defaults, readme size and linear score."""
    tokens = text.token_count(F.col("readme_text"))
    signals = F.col("quality_signals")
    if dict(records.dtypes)["quality_signals"] != "string":
        signals = F.to_json(signals)
    return conform(
        records.withColumns(
            {
                "source": F.coalesce("source", F.lit("hf")),
                "ns_local_id": F.coalesce("ns_local_id", "id"),
                "access_class": F.coalesce("access_class", F.lit("public")),
                "fingerprint": F.concat(F.lit("fixture:"), "id"),
                "indexed_at": values.at(indexed_at),
                "readme_tokens": tokens,
                "readme_score": text.score_linear(tokens),
                "quality_signals": signals,
            }
        ),
        DATASETS,
    )


def artifact_records(records: DataFrame, indexed_at: datetime) -> DataFrame:
    payload = F.col("payload")
    if dict(records.dtypes)["payload"] != "string":
        payload = F.to_json(payload)
    return conform(
        records.withColumns(
            {
                "payload": payload,
                "created_at": values.at(indexed_at),
                "stale": F.lit(False),
            }
        ),
        ARTIFACTS,
    )


def load_catalog(
    spark: SparkSession, path: str, indexed_at: datetime
) -> tuple[DataFrame, DataFrame]:
    """``(datasets, artifacts)`` of one or many catalog JSON files.

    A file that is one JSON document is parsed by one task; large catalogs come as
    ``load_records`` over many files.
    """
    files = spark.read.schema(_CATALOG).option("multiLine", True).json(path)
    datasets = files.select(F.explode("datasets").alias("d")).select("d.*")
    artifacts = files.select(F.explode("artifacts").alias("a")).select("a.*")
    return dataset_records(datasets, indexed_at), artifact_records(artifacts, indexed_at)


def load_records(
    spark: SparkSession, datasets_path: str, artifacts_path: str, indexed_at: datetime,
    fmt: str = "json",
) -> tuple[DataFrame, DataFrame]:
    """``(datasets, artifacts)`` of splittable files, one record per line or row."""
    def read(path: str, ddl: str) -> DataFrame:
        reader = spark.read.format(fmt)
        return (reader.schema(ddl) if fmt == "json" else reader).load(path)

    return (
        dataset_records(read(datasets_path, _DATASET), indexed_at),
        artifact_records(read(artifacts_path, _ARTIFACT), indexed_at),
    )


def read_listing(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A dump of a catalog listing, one entry per line or row."""
    reader = spark.read.format(fmt)
    rows = (reader.schema(LISTING) if fmt == "json" else reader).load(path)
    return conform(rows, LISTING)
