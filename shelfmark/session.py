"""Session for local use, and the folder for tables written between stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_session(cores: int | str = "*", app: str = "shelfmark") -> SparkSession:
    """A local session with adaptive execution and UTC; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names.

    Where it is unset a temporary folder serves a local session; a cluster must set it,
    as its executors do not share a machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="shelfmark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


_MATERIALIZED: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the folders of all tables that ``materialize`` has written in this process.

    It runs by itself when the process ends; frames that read these tables, or come from
    them, must not be used afterwards.
    """
    while _MATERIALIZED:
        spark, path = _MATERIALIZED.pop()
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session's process has ended before
            _MATERIALIZED.clear()


atexit.register(release)


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Compute a frame once, as a table in the shared folder, and read it from there.

    Later uses cost a scan of the result, and losing executors costs no recomputation. The
    folder is deleted by ``release``, at the latest when the process ends. ``options`` are
    those of the Parquet writer.
    """
    path = shared_dir(df.sparkSession, name)
    _MATERIALIZED.append((df.sparkSession, path))
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few given rows as a frame whose size the optimizer knows."""
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrow = to_arrow_schema(schema)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema)
