"""The catalog tables the registered queries run on, derived from the given tables.

Every rule here has a twin in SQL (``oracles.py``); both cover all rows of their source.
Each table is derived from all rows and whole texts once per session and kept as Parquet in
the shared folder, as a catalog keeps its tables.
"""

from __future__ import annotations

import threading
import zlib
from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text, values
from shelfmark.operators import search
from shelfmark.schemas import (
    ARTIFACTS, DATASETS, JOBS, LISTING, SEARCH_DOCS, SIGNALS, SIZE_CLASSES,
)
from shelfmark.session import literal_frame, shared_base
from shelfmark.sources import snapshots, stored_index
from shelfmark.sources.conform import conform

AS_OF = datetime(2024, 1, 31)
CURSOR = (datetime(2024, 1, 21), "ds/5")  # where the last listing run ended
INDEX_BUCKETS = 256

REQUESTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("request_id", "dataset_id", "kind")]
    + [T.StructField(n, T.IntegerType()) for n in ("budget_ms", "row_cap")]
)
SAMPLE_ROWS = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("row_json", T.StringType()),
    ]
)
QUERY_COLUMNS = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("query_id", "query", "modality", "license_class", "size_class", "language")
    ]
    + [T.StructField(n, T.IntegerType()) for n in ("limit", "offset")]
)
BATCH = T.StructType([*DATASETS.fields, T.StructField("batch_pos", T.LongType())])


def read(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A given table.

    A file that yields fewer scan tasks than there are cores is spread over the cores by
    ``key``; a table of many files is left as it is scanned.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if key and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df


def _every(column: str, n: int, rest: int = 0) -> Column:
    return F.col(column) % n == rest


def _choose(column: str, *options) -> Column:
    """One of the options by the column's remainder; None stands for NULL."""
    picked = F.lit(None)
    for i, option in enumerate(options):
        value = option if isinstance(option, Column) else F.lit(option)
        picked = F.when(_every(column, len(options), i), value).otherwise(picked)
    return picked


def _hours_before(n: Column) -> Column:
    return values.at(AS_OF) - F.make_dt_interval(hours=n.cast("int"))


_BUILDING = threading.RLock()


def _home(spark: SparkSession, sf_dir: str) -> str:
    place = f"{spark.sparkContext.applicationId}-{zlib.crc32(sf_dir.encode()):08x}"
    return f"{shared_base(spark)}/catalog-{place}"


def stored(schema: T.StructType):
    """Marks a derived table; the first query of a session that needs it writes it.

    Rows stay in the tasks that derive them: the texts are neither shuffled nor sorted.
    """
    def wrap(derive: Callable[[SparkSession, str], DataFrame]):
        @wraps(derive)
        def table(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = f"{_home(spark, sf_dir)}/{derive.__name__}"
            with _BUILDING:
                if snapshots.latest_version(spark, path) is None:
                    snapshots.write_snapshot(conform(derive(spark, sf_dir), schema), path, version=1)
            return snapshots.read_snapshot(spark, path, schema, version=1)

        return table

    return wrap


@stored(SEARCH_DOCS)
def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search documents of the datasets."""
    return search.build_search_docs(datasets(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored BM25 index of the search documents."""
    path = f"{_home(spark, sf_dir)}/index"
    with _BUILDING:
        if not stored_index.segments(spark, path):
            stored_index.write_inverted_index(docs(spark, sf_dir), path, INDEX_BUCKETS)
    return stored_index.read_inverted_index(spark, path, INDEX_BUCKETS)


@stored(DATASETS)
def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents", "doc_id")
    n, chars = F.col("doc_id"), F.col("n_chars")
    size = F.lit(SIZE_CLASSES[-1])
    for bound, name in reversed(list(zip((200, 500, 1000, 2000, 4000, 8000), SIZE_CLASSES))):
        size = F.when(chars < bound, name).otherwise(size)
    lm = F.when(~_every("doc_id", 11), _hours_before(n % 500))
    downloads = _choose(
        "doc_id", (n * 37 % 1000).cast("string"),
        F.concat(F.lit('"'), (n % 90).cast("string"), F.lit('"')),
        F.concat((n % 70).cast("string"), F.lit(".5")), "true", "null",
        F.concat((n * 37 % 1000).cast("string")), (n % 333).cast("string"),
    )
    quality = F.concat(
        F.lit('{"downloads":'), downloads, F.lit(',"likes":'), (n % 50).cast("string"), F.lit("}")
    )
    d = d.withColumns({"tokens": text.token_count(F.col("text")), "sha": F.sha2("text", 256)})
    tokens, sha, local_id = F.col("tokens"), F.col("sha"), n.cast("string")
    license_class = _choose("doc_id", "mit", "apache-2.0", "cc-by-4.0", "proprietary", None)
    return d.select(
        F.concat(F.lit("ds/"), local_id).alias("id"),
        "source",
        local_id.alias("ns_local_id"),
        F.when(~_every("doc_id", 13), F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"),
        F.nullif(F.split_part("text", F.lit("\n"), F.lit(2)), F.lit("")).alias("description"),
        F.col("text").alias("readme_text"),
        F.array("source", F.concat(F.lit("lang:"), "lang")).alias("tags"),
        F.when(_every("doc_id", 17), None)
        .when(_every("doc_id", 3), F.array(F.lit("image"), F.lit("text")))
        .otherwise(F.array(F.lit("text"))).alias("modalities"),
        license_class.alias("license_class"),
        F.when(_every("doc_id", 7), "private").otherwise("public").alias("access_class"),
        size.alias("size_class"),
        F.array("lang").alias("languages"),
        lm.alias("last_seen_lm"),
        sha.alias("readme_sha256"),
        text.fingerprint(
            F.col("source"), local_id, sha, values.iso_format(lm), size, license_class
        ).alias("fingerprint"),
        _hours_before(n % 72).alias("indexed_at"),
        tokens.alias("readme_tokens"),
        text.score_log(tokens).alias("readme_score"),
        quality.alias("quality_signals"),
    )


@stored(ARTIFACTS)
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema per label, stale where toxic (unset for some), and snips for low quality."""
    labels = read(spark, sf_dir, "labels")
    n = F.col("doc_id")
    dataset_id = F.concat(F.lit("ds/"), n.cast("string"))
    kinds = F.when(F.col("quality") == 0, F.array(F.lit("schema"), F.lit("snips"))).otherwise(
        F.array(F.lit("schema"))
    )
    return labels.select(
        dataset_id.alias("dataset_id"), F.explode(kinds).alias("kind"), "doc_id", "toxic"
    ).select(
        "dataset_id", "kind",
        F.when(
            ~_every("doc_id", 5),
            F.concat(F.lit('{"dataset_id":"'), "dataset_id", F.lit('","kind":"'), "kind", F.lit('"}')),
        ).alias("payload"),
        _hours_before(n % 30 * 24).alias("created_at"),
        F.when(~_every("doc_id", 19), F.col("toxic") == 1).alias("stale"),
    )


@stored(JOBS)
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events", "event_id")
    kind, n = F.col("event_type"), F.col("event_id")
    state = (
        F.when(kind.isin("purchase", "signup"), "done").when(kind == "error", "error")
        .when(kind == "click", "queued").otherwise("running")
    )
    started = F.when(state != "queued", F.timestamp_add("SECOND", F.lit(1), F.col("ts")))
    took = F.round(F.col("value") * 100000).cast("bigint")
    is_error = state == "error"
    return e.select(
        F.concat(F.lit("job-"), n.cast("string")).alias("id"),
        F.concat(F.lit("ds/"), F.col("user_id").cast("string")).alias("dataset_id"),
        _choose("event_id", "schema", "schema", "schema", "snips").alias("kind"),
        state.alias("state"),
        (n % 4).cast("int").alias("attempts"),
        F.when(
            is_error,
            _choose("event_id", "timeout", "rate_limited", "network", "parse_error", "unknown"),
        ).alias("error_class"),
        F.when(is_error, F.col("props")).alias("error_detail"),
        F.lit(1500).alias("budget_ms"),
        F.lit(200).alias("row_cap"),
        F.col("ts").alias("enqueued_at"),
        started.alias("started_at"),
        F.when(
            state.isin("done", "error"), F.timestamp_add("MICROSECOND", took, started)
        ).alias("finished_at"),
    )


@stored(SIGNALS)
def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return signal_columns(e.filter(F.col("event_type").isin("view", "click")))


def signal_columns(e: DataFrame) -> DataFrame:
    user = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("sig-"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("u"), user).alias("session_id"),
        user.alias("user_id"),
        F.col("event_type").alias("event"),
        F.concat(F.lit("ds/"), user).alias("dataset_id"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("query"),
        F.get_json_object("props", "$.k").cast("int").alias("rank"),
        F.col("ts").alias("created_at"),
    )


@stored(LISTING)
def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog listing: all documents and, as entries never seen before, all pages."""
    d, p = read(spark, sf_dir, "documents", "doc_id"), read(spark, sf_dir, "pages")
    n = F.col("doc_id")
    moment = _hours_before(n * 7 % 700)
    stamp = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    last_modified = (
        F.when(_every("doc_id", 29), "not a date")
        .when(_every("doc_id", 31), None)
        .otherwise(
            F.concat(stamp, _choose("doc_id", ".250Z", "+02:00", "", "Z"))
        )
    )
    name = F.when(_every("doc_id", 9), F.concat(F.lit("doc-"), n.cast("string"))).otherwise(
        F.concat(F.lit("ds/"), n.cast("string"))
    )
    docs = d.select(
        name.alias("id"), last_modified.alias("last_modified"),
        F.array("source").alias("tags"),
        _choose("doc_id", "mit", "", None, "proprietary").alias("license"),
        _every("doc_id", 7).alias("private"),
        (n * 37 % 1000).alias("downloads"),
        F.when(~_every("doc_id", 6), n % 50).alias("likes"),
        _every("doc_id", 5).alias("gated"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("card_title"),
        _every("doc_id", 2).alias("has_card"),
    )
    pages = p.select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("id"),
        F.concat(
            F.date_format(_hours_before(F.col("page_id") % 24), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")
        ).alias("last_modified"),
    )
    return docs.unionByName(pages, allowMissingColumns=True)


def stored_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog before a batch; some rows have no fingerprint yet."""
    known = F.col("ns_local_id").cast("bigint") % 23 != 0
    return datasets(spark, sf_dir).withColumn("fingerprint", F.when(known, F.col("fingerprint")))


@stored(BATCH)
def new_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch against the stored catalog: every labelled document again (changed where
    the quality is 1, without fingerprint where toxic, toxic ones twice) and every page."""
    labels = read(spark, sf_dir, "labels").select(
        F.concat(F.lit("ds/"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("n"), "quality", "toxic",
    )
    again = datasets(spark, sf_dir).join(labels, "id").withColumn(
        "fingerprint",
        F.when(F.col("toxic") == 1, None)
        .when(F.col("quality") == 1, F.sha2(F.concat("fingerprint", F.lit("v2")), 256))
        .otherwise(F.col("fingerprint")),
    )
    turns = F.when(F.col("toxic") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = (
        again.withColumn("turn", F.explode(turns))
        .withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit(" v"), F.col("turn").cast("string")))
        .withColumn("batch_pos", F.col("n") * 2 + F.col("turn"))
        .drop("n", "quality", "toxic", "turn")
    )
    pages = read(spark, sf_dir, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("id"),
        F.lit("web").alias("source"), F.col("url").alias("title"),
        F.md5("html").alias("fingerprint"), (-F.col("page_id") - 1).alias("batch_pos"),
    )
    return rows.unionByName(pages, allowMissingColumns=True)


@stored(REQUESTS)
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A resolve request per event; datasets beyond the catalog do not exist."""
    n = F.col("event_id")
    return read(spark, sf_dir, "events", "event_id").select(
        F.concat(F.lit("req-"), n.cast("string")).alias("request_id"),
        F.concat(F.lit("ds/"), n.cast("string")).alias("dataset_id"),
        F.when(F.col("event_type") == "view", "snips").otherwise("schema").alias("kind"),
        _choose("event_id", 1000, 2000, None, 0).cast("int").alias("budget_ms"),
        _choose("event_id", 100, None, 0, 150, 300).cast("int").alias("row_cap"),
    )


@stored(SAMPLE_ROWS)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows of five datasets (the event types), one per event."""
    n = F.col("event_id").cast("string")
    number = F.when(_every("event_id", 10), "null").when(
        _every("event_id", 7), F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"'))
    ).otherwise(F.col("value").cast("string"))
    body = F.concat(
        F.lit('{"event_id":'), n,
        F.when(_every("event_id", 3), F.concat(F.lit(',"user":"u'), F.col("user_id").cast("string"), F.lit('"'))).otherwise(F.lit("")),
        F.lit(',"value":'), number,
        F.lit(',"flag":'), F.when(_every("event_id", 2), "true").otherwise("false"),
        F.lit(',"list":['), n, F.lit(',1],"props":'), F.col("props"), F.lit("}"),
    )
    row = (
        F.when(_every("event_id", 23), F.concat(F.lit("["), n, F.lit("]")))
        .when(_every("event_id", 4), F.concat(F.lit('{"row_idx":'), n, F.lit(',"row":'), body, F.lit("}")))
        .otherwise(body)
    )
    return read(spark, sf_dir, "events", "event_id").select(
        F.col("event_type").alias("dataset_id"), F.col("event_id").alias("row_idx"),
        row.alias("row_json"),
    )


QUERIES = (
    # id, text, modality, license_class, size_class, language, limit, offset
    ("q1", "tion der", None, None, None, None, 30, 0),
    ("q2", "the The", "image", None, None, "EN", 20, 5),
    ("q3", "t_on e%d", None, "mit", None, None, 10, 0),
    ("q4", "zzzzqq", None, None, None, None, 30, 0),
    ("q5", "les   des", "text", None, "1M<n<10M", "fr", 30, 0),
    ("q6", "lang:en", "", "", None, None, 5, 100),
    ("q7", "   ", None, None, None, None, 30, 0),
    ("q8", "andti", None, None, None, None, 15, 0),
)


def queries(spark: SparkSession) -> DataFrame:
    """A few search requests to run against the whole catalog."""
    return literal_frame(spark, list(QUERIES), QUERY_COLUMNS)
