"""Connected components of an edge table, by alternating stars.

Every round sends, for each node, all its larger neighbours to the smallest one, then all its
smaller neighbours to the smallest one, until nothing changes. Minima are partial
aggregations, and a hub's edges are joined with one row, a join that adaptive execution
splits; no task or driver ever holds a component. Rounds are written to the shared folder, so
lineage stays short and lost executors repeat one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize


def _least(edges: DataFrame, by: str, other: str) -> DataFrame:
    return edges.groupBy(by).agg(F.min(other).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, "u", "v").select("u", F.least("u", "least").alias("least"))
    stars = both.where(F.col("v") > F.col("u")).join(least, "u")
    return stars.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger to the smaller node."""
    least = _least(edges, "u", "v")
    stars = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return stars.where("u <> v").union(least.select("u", F.col("least").alias("v"))).distinct()


def _mark() -> Column:
    return F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes with edges (``u``, ``v``); the smallest node names it."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(down.where("u <> v").distinct(), "edges")
    mark = now.agg(_mark()).first()[0]
    while True:
        now = materialize(_small_star(_large_star(now)), "edges")
        before, mark = mark, now.agg(_mark()).first()[0]
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
