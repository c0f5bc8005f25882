"""Search over the catalog: one request, or a batch of requests at once.

A search first works on narrow ``(id, score)`` rows and cuts them to the page; only then
are the wide columns of the few datasets on the page fetched.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text
from shelfmark.operators import filters as flt
from shelfmark.operators import joins, ordering
from shelfmark.operators import search as ops
from shelfmark.session import literal_frame, materialize

MAX_PAGE = 100  # fixed value: the largest page a request may ask for


def _check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"limit must be 1..{MAX_PAGE} and offset at least 0")


def _wide_page(
    scored: DataFrame, datasets: DataFrame, artifacts: DataFrame,
    tokens: list[str], limit: int, offset: int,
) -> DataFrame:
    """The page of ``scored(id, score)`` with every field of a hit.

    The page has at most 100 rows. Its ids become a literal filter, so the wide catalog
    is read by a pushed-down id filter instead of being joined.
    """
    spark = scored.sparkSession
    page = ordering.rank_hits(scored, limit, offset).collect()  # at most MAX_PAGE rows
    ids = [row["id"] for row in page]
    ranked = literal_frame(spark, page, scored.schema)
    fresh = flt.fresh_artifacts(artifacts).filter(F.col("dataset_id").isin(ids))
    found = datasets.filter(F.col("id").isin(ids)).join(F.broadcast(ranked), "id")
    asked = F.array(*[F.lit(t) for t in tokens])
    hits = joins.with_schema_flag(found, fresh).withColumn(
        "why", text.why_tokens(asked, text.search_content(found))
    )
    return flt.hit_projection(hits).orderBy(F.desc("score"), F.asc("id"))


def _nothing(datasets: DataFrame, artifacts: DataFrame):
    schema = T.StructType(
        [T.StructField("id", T.StringType()), T.StructField("score", T.IntegerType())]
    )
    none = literal_frame(datasets.sparkSession, [], schema)
    return _wide_page(none, datasets, artifacts, [""], 1, 0), none.agg(F.count("id").alias("total"))


def _finish(scored, datasets, artifacts, tokens, filters, limit, offset):
    """Page and total of one search; the matching itself runs once, for both."""
    if filters and any(filters.values()):
        eligible = flt.by_search_filters(datasets, filters).select("id")
        scored = scored.join(eligible, "id", "left_semi")
    scored = materialize(scored, "scored")
    hits = _wide_page(scored, datasets, artifacts, tokens, limit, offset)
    return hits, scored.agg(F.count(F.lit(1)).alias("total"))


def search_like(
    docs: DataFrame, datasets: DataFrame, artifacts: DataFrame, query: str,
    filters: dict[str, str | None] | None = None, limit: int = 30, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Substring search: ``(hits, total)``.

    A document matches when it contains any word of the query; the score is the number
    of words that match. ``%`` and ``_`` in a word are wildcards. A query without words
    finds nothing.
    """
    _check_page(limit, offset)
    tokens = query.lower().split()
    if not tokens:
        return _nothing(datasets, artifacts)
    score = text.match_score(F.col("content"), tokens)
    scored = docs.select(F.col("dataset_id").alias("id"), score.alias("score"))
    return _finish(
        scored.filter(F.col("score") > 0), datasets, artifacts, tokens, filters, limit, offset
    )


def search_bm25(
    index: ops.Index, datasets: DataFrame, artifacts: DataFrame, query: str,
    filters: dict[str, str | None] | None = None, limit: int = 30, offset: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Ranked full-text search: ``(hits, total)``. Documents share a term with the query."""
    _check_page(limit, offset)
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    tokens = query.lower().split()
    if not terms:
        return _nothing(datasets, artifacts)
    scored = (
        ops.with_bm25_share(ops.postings_of(index, terms), index)
        .groupBy(F.col("dataset_id").alias("id"))
        .agg(F.round(F.sum("share"), 6).alias("score"))
    )
    return _finish(scored, datasets, artifacts, tokens, filters, limit, offset)


def like_scores(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``(query_id, id, score)`` of a substring search for ``words`` of many queries."""
    pairs = ops.like_join(docs, words)
    return (
        ops.keyed_join(pairs, words, "token", "dataset_id")
        .groupBy("query_id", F.col("dataset_id").alias("id"))
        .agg(F.sum("weight").alias("score"))
    )


def _eligible_batch(scored: DataFrame, queries: DataFrame, datasets: DataFrame) -> DataFrame:
    """Scored rows that pass the filters of their query, with its page bounds."""
    asked = queries.select(
        "query_id", F.col("limit"), F.col("offset"),
        *[F.nullif(F.col(c), F.lit("")).alias(f"want_{c}")
          for c in ("modality", "license_class", "size_class", "language")],
    )
    facts = datasets.select(
        "id", "license_class", "size_class",
        text.json_text_list(F.col("modalities")).alias("modality"),
        text.json_text_list(F.col("languages")).alias("language"),
    )
    rows = scored.join(asked, "query_id").join(facts, "id")
    for column in ("license_class", "size_class"):
        want = F.col(f"want_{column}")
        rows = rows.filter(want.isNull() | (F.col(column) == want))
    for column in ("modality", "language"):
        want = F.col(f"want_{column}")
        rows = rows.filter(
            want.isNull() | text.matches_column(F.col(column), F.lower(want))
        )
    return rows.select("query_id", "id", "score", "limit", "offset")


def deepest_row(queries: DataFrame) -> int:
    """The largest ``offset + limit`` of a batch, whose pages are checked like single ones."""
    asked = queries.agg(
        F.min("limit").alias("least"), F.max("limit").alias("most"),
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("limit")).alias("deepest"),
    ).first()
    if asked["deepest"] is None:
        return 0
    _check_page(asked["least"], asked["first"])
    _check_page(asked["most"], asked["first"])
    return asked["deepest"]


def _pages(
    eligible: DataFrame, queries: DataFrame, datasets: DataFrame, artifacts: DataFrame
) -> DataFrame:
    """Page and total of every query; the matching itself runs once, for both."""
    eligible = materialize(eligible, "eligible")
    totals = eligible.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    page = ordering.rank_hits_batch(eligible, deepest_row(queries))
    page = materialize(page.select("query_id", "id", "score", "rn"), "page")
    if ops.is_short(page):  # no more rows than the limits of the queries add up to
        page = F.broadcast(page)
    tokens = queries.select("query_id", text.query_tokens(F.col("query")).alias("tokens"))
    found = page.join(datasets, "id").join(tokens, "query_id").join(totals, "query_id")
    hits = joins.with_schema_flag(found, artifacts).withColumn(
        "why", text.why_tokens(F.col("tokens"), text.search_content(found))
    )
    return hits.select(
        "query_id", "rn", "total", "id", "title", "score", "why", "has_schema",
        "license_class", "access_class", "size_class", "modalities", "languages", "tags",
    )


def search_batch(
    docs: DataFrame, datasets: DataFrame, artifacts: DataFrame, queries: DataFrame
) -> DataFrame:
    """Substring search for every row of ``queries``.

    ``queries`` has ``query_id, query, modality, license_class, size_class, language,
    limit, offset``. The result holds the page of each query with its ``total``.
    """
    words = ops.query_words(queries)
    eligible = _eligible_batch(like_scores(docs, words), queries, datasets)
    return _pages(eligible, queries, datasets, artifacts)


def search_with_fallback(
    index: ops.Index, docs: DataFrame, datasets: DataFrame,
    artifacts: DataFrame, queries: DataFrame,
) -> DataFrame:
    """BM25 for every query; those without any BM25 hit use the substring search."""
    ranked = ops.bm25_scores(index, ops.query_terms(queries))
    answered = materialize(_eligible_batch(ranked, queries, datasets), "answered")
    left = queries.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    words = ops.query_words(left)
    matched = _eligible_batch(like_scores(docs, words), left, datasets)
    eligible = answered.unionByName(matched.withColumn("score", F.col("score").cast("double")))
    return _pages(eligible, queries, datasets, artifacts)
