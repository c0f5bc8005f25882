"""Resolve requests in bulk: plan them, resolve schemas, build payloads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import joins, policy
from shelfmark.operators import resolve as ops
from shelfmark.schemas import EVENTS, JOBS, Settings
from shelfmark.session import materialize
from shelfmark.sources.conform import conform


def route_requests(
    requests: DataFrame, artifacts: DataFrame, datasets: DataFrame,
    settings: Settings = Settings(),
) -> DataFrame:
    """Requests with ``route`` (cached, blocked, queued) and, if blocked, ``reason_code``."""
    found = joins.request_join(requests, artifacts, datasets)
    judged = policy.policy_eval(policy.with_effective_budget(found, settings), settings)
    cached = F.col("has_artifact") & ~F.coalesce("stale", F.lit(False))
    return judged.withColumn(
        "route",
        F.when(cached, "cached").when(F.col("allow"), "queued").otherwise("blocked"),
    )


def plan_resolves(
    requests: DataFrame, artifacts: DataFrame, datasets: DataFrame, as_of: datetime,
    settings: Settings = Settings(),
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(cached, blocked, jobs, events)`` for ``requests(request_id, dataset_id, kind,
    budget_ms, row_cap)``.

    A fresh artifact answers a request at once; otherwise the policy either blocks it with
    a reason or lets it become a queued job, whose id is the request's id. The requests are
    routed once; the four results are read from that.
    """
    routed = materialize(
        route_requests(requests, artifacts, datasets, settings).select(
            "request_id", "dataset_id", "kind", "budget_ms", "row_cap", "route", "reason_code"
        ),
        "routed",
    )
    now = values.at(as_of)
    cached = routed.filter("route = 'cached'").select(
        "request_id", F.concat(F.lit("cached-"), "dataset_id").alias("job_id")
    )
    blocked = routed.filter("route = 'blocked'").select("request_id", "dataset_id", "reason_code")
    queued = routed.filter("route = 'queued'")
    jobs = queued.select(
        F.col("request_id").alias("id"), "dataset_id", "kind", F.lit("queued").alias("state"),
        F.lit(0).alias("attempts"), "budget_ms", "row_cap", now.alias("enqueued_at"),
    )
    payload = F.to_json(
        F.struct(F.col("request_id").alias("job_id"), "kind", "budget_ms", "row_cap")
    )
    events = queued.select(
        F.sha2(F.concat_ws("|", F.lit("dataset.requested"), "request_id"), 256).alias("id"),
        F.lit("dataset.requested").alias("type"), "dataset_id", payload.alias("payload"),
        now.alias("created_at"),
    )
    return cached, blocked, conform(jobs, JOBS), conform(events, EVENTS)


# Fixed value: what a payload names as its source.
PAYLOAD_SOURCE = "hf_connector"


def resolve_schemas(
    jobs: DataFrame, info: DataFrame, rows: DataFrame, cards: DataFrame,
    source: str = PAYLOAD_SOURCE,
) -> DataFrame:
    """``(job_id, dataset_id, payload)``: the schema of each job's dataset.

    Declared features of the dataset info come first, then those inferred from its sample
    rows (read only where a config and split are known), then those on its card, else an
    empty schema with a note. ``jobs`` may carry ``elapsed_ms``, the time a fetch took.
    """
    known = ops.features_from_info(info)
    flags = values.budget_flags(
        F.col("budget_ms"), F.col("row_cap"),
        F.col("elapsed_ms") if "elapsed_ms" in jobs.columns else F.lit(0),
    )
    jobs = jobs.withColumn("flags", flags).withColumn("cap", F.col("flags.row_cap_applied"))
    lacking = known.filter(
        F.col("features").isNull()
        & (F.coalesce("config", F.lit("")) != "")
        & (F.coalesce("split", F.lit("")) != "")
    ).select("dataset_id")
    asked = jobs.select("dataset_id", "cap").distinct().join(lacking, "dataset_id", "left_semi")
    # Cut every dataset to the largest cap, in map tasks, before rows meet jobs: what is
    # joined then has a bounded number of rows per dataset.
    widest = jobs.agg(F.max("cap")).first()[0] or 0
    sampled = ops.first_rows(rows, widest).join(asked, "dataset_id")
    inferred = ops.features_from_rows(
        sampled.filter("row_idx < cap"), by=("dataset_id", "cap")
    ).withColumnRenamed("features", "inferred")
    carded = ops.features_from_card(cards).withColumnRenamed("features", "carded")
    elapsed = F.col("elapsed_ms") if "elapsed_ms" in jobs.columns else F.lit(0)
    joined = (
        jobs.join(known, "dataset_id", "left")
        .join(inferred, ["dataset_id", "cap"], "left")
        .join(carded, "dataset_id", "left")
        .withColumn("elapsed", elapsed.cast("int"))
        .withColumn(
            "schema",
            F.coalesce(
                "features",
                F.when(F.col("inferred") != "[]", F.col("inferred")),
                F.when(~F.col("carded").isin("[]", "{}"), F.col("carded")),
            ),
        )
    )
    base = F.to_json(
        F.struct(
            "dataset_id", "kind", "flags.row_cap_applied", F.col("elapsed").alias("fetched_ms"),
            "flags.budget_ms_requested", "flags.budget_exhausted", F.lit(source).alias("source"),
        )
    )
    names = F.to_json(F.struct("config", "split"), {"ignoreNullFields": "false"})
    open_base = F.substring(base, F.lit(1), F.length(base) - 1)
    payload = F.when(
        F.col("schema").isNull(),
        F.concat(open_base, F.lit(',"schema":[],"note":"schema_not_available"}')),
    ).otherwise(
        F.concat(
            open_base, F.lit(',"schema":'), F.col("schema"), F.lit(","),
            F.substring(names, F.lit(2), F.length(names)),
        )
    )
    return joined.select(F.col("id").alias("job_id"), "dataset_id", payload.alias("payload"))
