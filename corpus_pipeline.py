"""A corpus pipeline of the training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame; ``run`` writes it as Parquet in
the shared folder and gives it to the next stage. All stages but the last return the columns
of ``documents``. ``docs`` may hold null texts, repeated rows and no rows at all: null texts
are scored as empty ones and fail the quality rules, repeated rows share one fate until
deduplication, which leaves one row of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import near_dup, packing, pii, rules, toxicity
from shelfmark.llm.common import table
from shelfmark.session import materialize

#: Ids up to this number are broadcast to drop rows; beyond it, rows meet them in a shuffle.
BROADCAST_ROWS = 1_000_000

#: No SQL can express the learnt stages; the tests hold each stage against a plain version.
ORACLE_SQL = None


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``ids``; rows without an id stay."""
    stored = materialize(ids.select("doc_id").distinct(), "dropped-ids")
    if stored.count() <= BROADCAST_ROWS:
        stored = F.broadcast(stored)
    return docs.join(stored, "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learnt on these and their labels."""
    weights = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, weights)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the learnt decision list."""
    learnt = rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return rules.filter_kept(docs, learnt)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, the one with the smallest id.

    Rows that share an id but not the text are documents of their own: the class keeps the
    smallest id and of its texts the one with the smallest digest. Of rows with the same id
    and text the one smallest as JSON stays. Rows without an id all stay.
    """
    if not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return _one_of_each_text(docs)
    classes = materialize(near_dup.near_duplicates(docs), "classes")
    return drop_ids(docs, classes.where(F.col("doc_id") != F.col("class_id")))


def _one_of_each_text(docs: DataFrame) -> DataFrame:
    """``drop_near_duplicates`` where ids repeat: distinct texts of an id are numbered in order."""
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").alias("id"), digest.alias("digest"), F.struct("*").alias("row")
    )
    once = rows.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    number = F.monotonically_increasing_id().alias("doc_id")
    numbered = materialize(once.orderBy("id", "digest").select(number, "row"), "numbered-texts")
    classes = materialize(near_dup.near_duplicates(numbered.select("doc_id", "row.text")), "classes")
    kept = drop_ids(numbered, classes.where(F.col("doc_id") != F.col("class_id")))
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    redacted = pii.redact(docs)
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast("long"))
    return redacted.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
