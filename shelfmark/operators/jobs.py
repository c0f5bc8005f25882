"""State changes of resolve jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values
from shelfmark.operators import ordering


def reclaim_stale(
    jobs: DataFrame, as_of: datetime, lease_sec: float, max_attempts: int = 3
) -> DataFrame:
    """Running jobs older than the lease, with attempts left, are queued again."""
    if lease_sec <= 0:
        return jobs
    cutoff = values.at(as_of) - F.make_dt_interval(secs=F.lit(lease_sec).cast("decimal(18,6)"))
    stale = F.coalesce(
        (F.col("state") == "running")
        & (F.col("started_at") < cutoff)
        & (F.col("attempts") < max_attempts),
        F.lit(False),
    )

    def cleared(column: str) -> Column:
        return F.when(~stale, F.col(column))

    return jobs.withColumns(
        {
            "state": F.when(stale, "queued").otherwise(F.col("state")),
            "started_at": cleared("started_at"),
            "finished_at": cleared("finished_at"),
        }
    )


def start_jobs(jobs: DataFrame, n: int, as_of: datetime) -> DataFrame:
    """The ``n`` jobs that wait longest start running.

    The cut between started and waiting is one ``(time, id)`` pair, so the jobs are
    compared with it in place: they are not joined or moved.
    """
    last = (
        ordering.due_jobs(jobs, n)
        .agg(F.max(_queue_place()).alias("last"))
        .scalar()
    )
    starts = F.coalesce((F.col("state") == "queued") & (_queue_place() <= last), F.lit(False))
    return jobs.withColumns(
        {
            "state": F.when(starts, "running").otherwise(F.col("state")),
            "started_at": F.when(starts, values.at(as_of)).otherwise(F.col("started_at")),
        }
    )


def _queue_place() -> Column:
    """Sort key of a waiting job; one without a time waits behind all others."""
    return F.struct(
        F.col("enqueued_at").isNull().alias("untimed"), F.col("enqueued_at"), F.col("id")
    )


def latest_state(transitions: DataFrame) -> DataFrame:
    """The last record per job id by ``(at, seq)``; works on a log of job records.

    The choice aggregates a struct per job, combined before the shuffle, so a job with
    very many records costs one row per task.
    """
    rest = [c for c in transitions.columns if c != "id"]
    return (
        transitions.groupBy("id")
        .agg(F.max(F.struct("at", "seq", F.struct(*rest).alias("rec"))).alias("last"))
        .select("id", "last.rec.*")
    )
