"""Filters, lookups and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text, values


def by_license(datasets: DataFrame, license_class: str) -> DataFrame:
    return datasets.filter(F.col("license_class") == license_class)


def by_size(datasets: DataFrame, size_class: str) -> DataFrame:
    return datasets.filter(F.col("size_class") == size_class)


def _by_list(df: DataFrame, column: str, value: str, mode: str) -> DataFrame:
    """``like`` tests the JSON text of the list (the argument is lower-cased, the list
    is not); ``exact`` tests for an equal item."""
    if mode == "exact":
        return df.filter(F.array_contains(column, value))
    if mode != "like":
        raise ValueError(f"mode must be 'like' or 'exact', not {mode!r}")
    return df.filter(text.matches_literal(text.json_text_list(F.col(column)), value.lower()))


def by_modality(datasets: DataFrame, modality: str, mode: str = "like") -> DataFrame:
    return _by_list(datasets, "modalities", modality, mode)


def by_language(datasets: DataFrame, language: str, mode: str = "like") -> DataFrame:
    return _by_list(datasets, "languages", language, mode)


def by_search_filters(datasets: DataFrame, filters: dict[str, str | None] | None) -> DataFrame:
    """Apply the filters of a search request; an empty value does not filter."""
    steps = {
        "modality": by_modality, "license_class": by_license,
        "size_class": by_size, "language": by_language,
    }
    for name, step in steps.items():
        if (filters or {}).get(name):
            datasets = step(datasets, filters[name])
    return datasets


def lookup_datasets(datasets: DataFrame, ids: DataFrame) -> DataFrame:
    """The datasets whose id is in ``ids(id)``."""
    return datasets.join(ids.select("id"), "id", "left_semi")


def lookup_artifacts(artifacts: DataFrame, keys: DataFrame) -> DataFrame:
    """Servable artifacts for ``keys(dataset_id, kind)``; no valid payload reads ``{}``.

    An artifact is servable unless it is marked stale; an unset mark does not block it.
    """
    return (
        artifacts.filter(~F.coalesce(F.col("stale"), F.lit(False)))
        .join(keys.select("dataset_id", "kind"), ["dataset_id", "kind"], "left_semi")
        .withColumn(
            "payload",
            F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise("{}"),
        )
    )


def fresh_artifacts(artifacts: DataFrame, kind: str = "schema") -> DataFrame:
    """Artifacts of a kind known not to be stale (an unset mark is not fresh)."""
    return artifacts.filter((F.col("kind") == kind) & (F.col("stale") == F.lit(False)))


def thin_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.filter(values.is_thin(F.col("readme_tokens"), F.col("readme_score")))


def hit_projection(df: DataFrame) -> DataFrame:
    """The record of a search hit: lists without NULL, counters out of the quality JSON.

    ``why``, ``has_schema``, ``score`` are kept when the input has them.
    """
    def or_empty(column: str):
        return F.coalesce(F.col(column), F.array().cast("array<string>")).alias(column)

    found = [c for c in ("has_schema", "score", "why") if c in df.columns]
    return df.select(
        "id", "title", "description", "readme_text",
        "license_class", "access_class", "size_class",
        or_empty("modalities"), or_empty("languages"), or_empty("tags"),
        F.get_json_object("quality_signals", "$.downloads").alias("downloads"),
        F.get_json_object("quality_signals", "$.likes").alias("likes"),
        F.lit(None).cast("string").alias("blocked_reason"),
        *found,
    )


def display_description(df: DataFrame) -> DataFrame:
    """What a result card shows: a title, a short text and up to three tags."""
    readme = F.nullif(F.col("readme_text"), F.lit(""))
    snippet = F.when(
        F.length(readme) > 200, F.concat(F.substring(readme, 1, 200), F.lit("…"))
    ).otherwise(readme)
    return df.select(
        "id",
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id")).alias("shown_title"),
        F.coalesce(
            F.nullif(F.col("description"), F.lit("")), snippet, F.lit("No description")
        ).alias("shown_text"),
        F.coalesce(F.array_join(F.slice("tags", 1, 3), ", "), F.lit("")).alias("shown_tags"),
    )
