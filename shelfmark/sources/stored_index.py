"""The BM25 index as stored segments with a commit point.

A segment holds the postings of one build, of one update or of several merged ones, with its
part of the document frequencies and corpus sizes, and masks: the ids whose postings in older
segments no longer count. Its files lie in ``<kind>/level=<l>/version=<v>`` for each kind. Only
the manifest says which segments are in force. It is a versioned table and written last, so
readers see an update or a merge whole or not at all.

Updates are of level 0. When ``FANOUT`` segments of a level follow one another they are merged
into one of the next level, so u updates leave no more than ``FANOUT * log(u)`` segments and
each posting is rewritten once for each level. The build itself stays as it is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import search
from shelfmark.sources import snapshots

FANOUT = 4
PART_ROWS = 600_000  # about 64 MB to sort
_BASE_LEVEL = 99
_COLUMNS = {
    "postings": "term string, dataset_id string, tf int, dl int",
    "terms": "term string, df bigint",
    "corpus": "docs bigint, terms bigint",
    "masks": "dataset_id string",
}
_BUCKETED = ("postings", "terms")


class Segment(NamedTuple):
    """``version`` is that of the last update in it."""

    level: int
    version: int


def segments(spark: SparkSession, path: str) -> list[Segment]:
    """The segments in force, oldest first; none if nothing is committed."""
    schema = spark.createDataFrame([], "level int, version int").schema
    if snapshots.latest_version(spark, f"{path}/manifest") is None:
        return []
    rows = snapshots.read_snapshot(spark, f"{path}/manifest", schema).collect()
    return sorted((Segment(r["level"], r["version"]) for r in rows), key=lambda s: s.version)


def _commit(spark: SparkSession, path: str, found: list[Segment]) -> None:
    rows = spark.createDataFrame(found, "level int, version int").coalesce(1)
    snapshots.write_snapshot(rows, f"{path}/manifest")


def _folder(path: str, kind: str, segment: Segment) -> str:
    return f"{path}/{kind}/level={segment.level}/version={segment.version}"


def _write(rows: DataFrame, path: str, kind: str, segment: Segment) -> DataFrame:
    writer = rows.write.mode("overwrite")
    if kind in _BUCKETED:
        writer = writer.partitionBy("bucket")
    writer.parquet(_folder(path, kind, segment))
    return _read(rows.sparkSession, path, kind, [segment])


def _read(spark: SparkSession, path: str, kind: str, found: list[Segment]) -> DataFrame:
    bucket = ", bucket int" if kind in _BUCKETED else ""
    reader = spark.read.schema(f"{_COLUMNS[kind]}, level int, version int{bucket}").option("basePath", f"{path}/{kind}")
    return reader.parquet(*[_folder(path, kind, s) for s in found]).drop("level")


def _write_postings(postings: DataFrame, path: str, segment: Segment, buckets: int, about: int) -> DataFrame:
    """Postings by bucket and term, in parts of ``PART_ROWS`` if there are ``about`` so many.

    A task sorts its part in memory, whatever the size of the index: a large bucket is spread
    over several parts by dataset, and several small ones share a part.
    """
    wanted = max(1, -(-about // PART_ROWS))
    spread = max(1, round(wanted / buckets))  # cells of one bucket
    cells = buckets * spread
    parts = min(wanted, cells)
    cell = F.col("bucket") * spread + F.pmod(F.hash("dataset_id"), F.lit(spread))
    laid = postings.repartitionById(parts, F.floor(cell * parts / cells).cast("int"))
    return _write(laid.sortWithinPartitions("bucket", "term"), path, "postings", segment)


def _about(docs: DataFrame) -> int:
    """About how many postings documents have, for the number of parts only: one for every
    twelve characters."""
    return docs.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("n")).first()["n"] // 12


def _bucketed(postings: DataFrame, buckets: int) -> DataFrame:
    return postings.withColumn("bucket", search.bucket_of(F.col("term"), buckets))


def _total(counts: DataFrame) -> DataFrame:
    return counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("docs", "terms")])


def write_inverted_index(docs: DataFrame, path: str, buckets: int = 256) -> None:
    """Store the index so that a query reads only the folders of its terms.

    A build that broke off is run again; a committed index is brought up to date instead.
    """
    spark = docs.sparkSession
    if segments(spark, path):
        raise ValueError(f"{path} holds an index")
    base = Segment(_BASE_LEVEL, 0)
    written = _write_postings(_bucketed(search.postings_rows(docs), buckets), path, base, buckets, _about(docs))
    counts = written.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    _write(counts.repartition("bucket"), path, "terms", base)
    _write(search.corpus_counts(docs, written), path, "corpus", base)
    _write(docs.select("dataset_id").limit(0), path, "masks", base)
    _commit(spark, path, [base])


def update_inverted_index(
    old: DataFrame, new: DataFrame, path: str, version: int, buckets: int = 256, fanout: int = FANOUT
) -> None:
    """Bring a stored index up to date with changed documents only.

    ``old`` and ``new`` are the search documents of the changed ids before and after. Their
    postings are added as a segment; older postings of these ids are masked, and document
    frequencies and corpus sizes are added as differences. ``version`` is 1 or more and rises;
    an update that broke off is run again with the same one, and one that is already committed
    changes nothing. Small segments are merged afterwards.
    """
    spark = old.sparkSession
    found = segments(spark, path)
    if not found:
        raise ValueError(f"{path} holds no index")
    if version > found[-1].version:
        mine = Segment(0, version)
        added = _write_postings(_bucketed(search.postings_rows(new), buckets), path, mine, buckets, _about(new))
        gone = _bucketed(search.postings_rows(old), buckets)
        signed = added.select("bucket", "term", F.lit(1).alias("n")).unionByName(
            gone.select("bucket", "term", F.lit(-1).alias("n"))
        )
        counts = signed.groupBy("bucket", "term").agg(F.sum("n").alias("df")).filter("df <> 0")
        _write(counts.repartition("bucket"), path, "terms", mine)
        before, after = search.corpus_counts(old, gone), search.corpus_counts(new, added)
        less = before.select((-F.col("docs")).alias("docs"), (-F.col("terms")).alias("terms"))
        _write(_total(after.unionByName(less)), path, "corpus", mine)
        changed = old.select("dataset_id").unionByName(new.select("dataset_id")).distinct()
        _write(changed, path, "masks", mine)
        _commit(spark, path, [*found, mine])
    compact_index(spark, path, fanout)


def compact_index(spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
    """Merge neighbours of one level as long as there are ``fanout`` of them at the end.

    What is merged stays on disk, for readers that still use it, but is not in force any more.
    """
    while True:
        found = segments(spark, path)
        tail = found[-fanout:]
        if len(tail) < fanout or len({s.level for s in tail}) > 1:
            return
        merged = Segment(tail[0].level + 1, tail[-1].version)
        stored = _read(spark, path, "postings", tail)
        buckets = 1 + (stored.agg(F.max("bucket").alias("n")).first()["n"] or 0)
        _write_postings(_live(spark, path, tail).drop("version"), path, merged, buckets, stored.count())
        counts = _read(spark, path, "terms", tail).groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        _write(counts.filter("df <> 0").repartition("bucket"), path, "terms", merged)
        _write(_total(_read(spark, path, "corpus", tail)), path, "corpus", merged)
        _write(_read(spark, path, "masks", tail).select("dataset_id").distinct(), path, "masks", merged)
        _commit(spark, path, [*found[:-fanout], merged])


def _live(spark: SparkSession, path: str, found: list[Segment]) -> DataFrame:
    """The postings of neighbouring segments without those that a later one masks."""
    postings = _read(spark, path, "postings", found)
    if len(found) == 1:
        return postings
    masks = _read(spark, path, "masks", found[1:])
    last = masks.groupBy("dataset_id").agg(F.max("version").alias("since"))
    last = F.broadcast(last) if search.is_short(last) else last
    outdated = (postings["dataset_id"] == last["dataset_id"]) & (postings["version"] < last["since"])
    return postings.join(last, outdated, "left_anti")


def read_inverted_index(spark: SparkSession, path: str, buckets: int = 256) -> search.Index:
    """A stored index with its updates; ``buckets`` is the number it was written with."""
    found = segments(spark, path)
    if not found:
        raise ValueError(f"{path} holds no index")
    terms = _read(spark, path, "terms", found).drop("version")
    if len(found) > 1:
        terms = terms.groupBy("bucket", "term").agg(F.sum("df").alias("df")).filter("df > 0")
    corpus = _total(_read(spark, path, "corpus", found))
    return search.Index(_live(spark, path, found).drop("version"), terms, search.averages(corpus), buckets)
