"""The policy gate in front of resolving a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.schemas import SIZE_CLASSES, Settings


def policy_eval(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``allow`` and ``reason_code``.

    The input has ``known, access_class, license_class, size_class, budget_ms, row_cap``,
    where ``known`` says whether the dataset exists. The first rule that denies gives the
    reason. Empty text counts as not set, and what is not set passes; so does an unknown
    size class, and an unknown ceiling switches the size rule off.
    """
    access = F.nullif(F.col("access_class"), F.lit(""))
    license_class = F.nullif(F.col("license_class"), F.lit(""))
    ceiling = (
        SIZE_CLASSES.index(settings.max_size_class)
        if settings.max_size_class in SIZE_CLASSES
        else None
    )
    too_large = (
        F.lit(False) if ceiling is None else values.size_rank(F.col("size_class")) > ceiling
    )
    reason = (
        F.when(~F.coalesce(F.col("known"), F.lit(False)), "not_applicable")
        .when(access != "public", "gated_private")
        .when(~license_class.isin(list(settings.license_allowlist)), "license_denied")
        .when(too_large, "size_exceeded")
        .when(F.col("budget_ms") > settings.resolve_budget_ms, "time_budget_exceeded")
        .when(F.col("row_cap") > settings.resolve_row_cap, "time_budget_exceeded")
    )
    return df.withColumn("reason_code", reason).withColumn(
        "allow", F.col("reason_code").isNull()
    )


def with_effective_budget(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Replaces missing or zero budgets by the defaults."""
    return df.withColumns(
        {
            "budget_ms": values.effective_budget(F.col("budget_ms"), settings.resolve_budget_ms),
            "row_cap": values.effective_budget(F.col("row_cap"), settings.resolve_row_cap),
        }
    )
