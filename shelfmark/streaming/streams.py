"""Structured Streaming jobs. Each one processes what is there and stops.

State that a batch merges into lives in versioned tables; a batch writes only the rows it
changes, as a delta with the number of the micro-batch, so a batch that is run again after
a failure finds its own version complete and changes nothing.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions import values
from shelfmark.operators import jobs as job_ops
from shelfmark.operators import upsert
from shelfmark.schemas import ARTIFACTS, DATASETS, EVENTS, SIGNALS
from shelfmark.session import materialize
from shelfmark.sources import logs, snapshots
from shelfmark.sources.conform import conform

STATE = {"datasets": (DATASETS, ["id"]), "artifacts": (ARTIFACTS, ["dataset_id", "kind"])}
JOB_STATE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("at", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
    ]
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet file of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    )


def read_folder(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(spark.read.parquet(folder).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of a log that is written in one folder per micro-batch."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _write_log(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    """One batch's rows, in a folder of its own; a batch that is run again replaces them."""
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def _run_of(batch: DataFrame) -> str:
    """The id a stream keeps as long as its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def stream_signals(
    source: DataFrame, sink: str, checkpoint: str, as_of: datetime
) -> StreamingQuery:
    """Appends signals to the log, each id once, however late it comes.

    Every batch is held against the ids of the whole log, so the log is the same as after
    ``append_signals`` of all signals at once, in whatever order they arrive. Signals
    without an id get one; a missing time becomes ``as_of``.
    """
    spark = source.sparkSession
    spark.createDataFrame([], SIGNALS).write.mode("ignore").parquet(f"{sink}/run=none/batch=0")

    def append(batch: DataFrame, batch_id: int) -> None:
        run = _run_of(batch)
        logged = read_log(spark, sink, SIGNALS).filter(
            ~F.contains(F.input_file_name(), F.lit(f"/run={run}/batch={batch_id}/"))
        )
        rows = logs.signal_rows(batch, as_of).join(logged.select("id"), "id", "left_anti")
        _write_log(rows.select(*SIGNALS.names), sink, run, batch_id)

    return (
        source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_popularity(
    source: DataFrame, sink: str, checkpoint: str, delay: str = "1 day"
) -> StreamingQuery:
    """Signals per dataset over 7 days, sliding by a day; closed windows only."""
    counted = (
        source.select("dataset_id", values.instant(F.col("created_at")).alias("seen_at"))
        .withWatermark("seen_at", delay)
        .groupBy(F.window("seen_at", "7 days", "1 day"), "dataset_id")
        .agg(F.count(F.lit(1)).alias("sig_score"))
        .select(
            values.utc(F.col("window.start")).alias("window_start"),
            values.utc(F.col("window.end")).alias("window_end"),
            "dataset_id", "sig_score",
        )
    )
    return (
        counted.writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )


def current(spark: SparkSession, state_path: str, name: str, below: int | None = None) -> DataFrame:
    """The newest state of a table kept by ``stream_upsert_datasets``."""
    schema, keys = STATE[name]
    return snapshots.read_current(spark, f"{state_path}/{name}", schema, keys, below)


def stream_upsert_datasets(
    source: DataFrame, state_path: str, checkpoint: str, as_of: datetime, seed_version: int = 1,
    compact_every: int = 16,
) -> StreamingQuery:
    """Merges a stream of dataset rows into the stored catalog.

    Below ``state_path`` are the tables ``datasets`` and ``artifacts`` and the change log
    ``events``. ``seed_version`` is the state the stream started from (it may be missing);
    it stays the same as long as the checkpoint does. A batch compares itself with the ids
    and fingerprints of the versions before its own; its dataset rows are written last, so
    a batch counts as merged only when all it caused is written. The batch is stored once
    and read from there. After every ``compact_every`` batches the changes are folded into
    a full version, so reading never has to merge more than that many.
    """
    spark = source.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        version = seed_version + batch_id + 1
        batch = materialize(batch, "micro-batch")
        stored = current(spark, state_path, "datasets", below=version)
        artifacts = current(spark, state_path, "artifacts", below=version)
        compared = materialize(upsert.compare_fingerprints(stored, batch), "compared")
        changed = upsert.changed_of(compared)
        hit = artifacts.join(changed.withColumnRenamed("id", "dataset_id"), "dataset_id", "left_semi")
        events = upsert.change_events(compared, as_of)
        latest = conform(upsert.last_per_key(batch, ["id"]), DATASETS)
        _write_log(conform(events, EVENTS), f"{state_path}/events", "merge", version)
        snapshots.write_delta(
            conform(hit.withColumn("stale", F.lit(True)), ARTIFACTS), f"{state_path}/artifacts", version
        )
        snapshots.write_delta(latest, f"{state_path}/datasets", version)
        if version % compact_every == 0:
            for name, (schema, keys) in STATE.items():
                snapshots.compact(spark, f"{state_path}/{name}", schema, keys)

    return (
        source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_job_state(
    source: DataFrame, state_path: str, checkpoint: str, compact_every: int = 16
) -> StreamingQuery:
    """Keeps the last state of every job from a stream of ``(id, state, at, seq)``.

    A batch stores the last record of each of its jobs; which of them is the newest of all
    is settled by time when the state is read. Every ``compact_every`` batches the records
    are folded into one for each job and older folders go, so reading the state meets one
    snapshot and fewer than that many batches, however long the stream has run.
    """
    spark = source.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        last = job_ops.latest_state(conform(batch, JOB_STATE)).select(*JOB_STATE.names)
        snapshots.write_delta(last, state_path, version)
        if version % compact_every == 0:
            snapshots.write_snapshot(current_job_state(spark, state_path), state_path, version)
            snapshots.drop_folded(spark, state_path)

    return (
        source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_job_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The last record of every job."""
    base = snapshots.latest_version(spark, state_path)
    records = snapshots.read_snapshot(spark, state_path, JOB_STATE, base)
    deltas = snapshots.read_deltas(spark, state_path, JOB_STATE, base=base or 0)
    if deltas is not None:
        records = records.unionByName(deltas.drop("batch_pos"))
    return job_ops.latest_state(records)
