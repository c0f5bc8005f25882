"""Versioned tables: full snapshots and small deltas on top of them.

A table lives in ``<path>/v00000001`` (all rows) and ``<path>/d00000002`` (rows changed by
one batch). A version counts once its ``_SUCCESS`` file exists, which Spark writes after
all tasks are committed, so readers never see a half-written version and a failed write
leaves the last one in force. No version is overwritten once it is complete.

A small batch costs a small write: the stored rows are not rewritten. Readers merge the
deltas after the last snapshot, and ``compact`` folds them into a new one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.upsert import merge_rows
from shelfmark.sources.conform import conform

_VERSION = re.compile(r"([vd])(\d{8})$")


def _versions(spark: SparkSession, path: str) -> dict[tuple[str, int], bool]:
    """Snapshots ``("v", n)`` and deltas ``("d", n)``, and whether each is complete."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return {}
    found = {}
    for status in fs.listStatus(root):
        match = _VERSION.search(status.getPath().getName())
        if match:
            done = fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            found[match.group(1), int(match.group(2))] = done
    return found


def _complete(spark: SparkSession, path: str, kind: str, below: int | None) -> list[int]:
    return sorted(
        n for (k, n), done in _versions(spark, path).items()
        if k == kind and done and (below is None or n < below)
    )


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path.rstrip('/')}/{kind}{number:08d}"


def latest_version(spark: SparkSession, path: str, below: int | None = None) -> int | None:
    """The newest complete snapshot, or the newest one below a given number."""
    return max(_complete(spark, path, "v", below), default=None)


def _write(df: DataFrame, path: str, kind: str, version: int | None) -> str:
    known = _versions(df.sparkSession, path)
    number = max((n for _, n in known), default=0) + 1 if version is None else version
    target = _folder(path, kind, number)
    if not known.get((kind, number)):
        df.write.mode("overwrite").parquet(target)
    return target


def write_snapshot(df: DataFrame, path: str, version: int | None = None) -> str:
    """Write all rows as the next version and return its folder.

    With a given ``version`` a write that is already complete is left as it is, which
    makes a repeated micro-batch harmless.
    """
    return _write(df, path, "v", version)


def write_delta(df: DataFrame, path: str, version: int) -> str:
    """Write the rows one batch changed, each key once."""
    return _write(df.withColumn("batch_pos", F.lit(version).cast("bigint")), path, "d", version)


def read_snapshot(
    spark: SparkSession, path: str, schema: T.StructType, version: int | None = None
) -> DataFrame:
    """The newest complete snapshot, or the given one; an empty table if there is none."""
    number = latest_version(spark, path) if version is None else version
    if number is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_folder(path, "v", number))


def read_deltas(
    spark: SparkSession, path: str, schema: T.StructType, below: int | None = None,
    base: int | None = None,
) -> DataFrame | None:
    """Changed rows since a snapshot, by default the last, with their version as ``batch_pos``."""
    base = (latest_version(spark, path, below) or 0) if base is None else base
    numbers = [n for n in _complete(spark, path, "d", below) if n > base]
    if not numbers:
        return None
    wanted = T.StructType([*schema.fields, T.StructField("batch_pos", T.LongType())])
    return spark.read.schema(wanted).parquet(*[_folder(path, "d", n) for n in numbers])


def read_current(
    spark: SparkSession, path: str, schema: T.StructType, keys: list[str], below: int | None = None
) -> DataFrame:
    """The last snapshot with the deltas after it: the newest row of every key."""
    number = latest_version(spark, path, below)
    base = (
        spark.createDataFrame([], schema)
        if number is None
        else read_snapshot(spark, path, schema, number)
    )
    # From the snapshot that was read: another one may have been written since.
    deltas = read_deltas(spark, path, schema, below, number or 0)
    return base if deltas is None else conform(merge_rows(base, deltas, keys, schema), schema)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: list[str]) -> None:
    """Fold the deltas into a snapshot with the number of the last one."""
    deltas = _complete(spark, path, "d", None)
    if deltas and deltas[-1] > (latest_version(spark, path) or 0):
        write_snapshot(read_current(spark, path, schema, keys), path, deltas[-1])


def drop_folded(spark: SparkSession, path: str) -> None:
    """Delete what is older than the last snapshot but one, for tables without a history.

    A reader that began at that snapshot still finds its files, and a repeated batch the
    versions below its own.
    """
    snapshots = _complete(spark, path, "v", None)
    if len(snapshots) < 2:
        return
    for kind, number in _versions(spark, path):
        if number < snapshots[-2] or (kind == "d" and number == snapshots[-2]):
            folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(path, kind, number))
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
