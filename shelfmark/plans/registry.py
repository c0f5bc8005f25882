"""The registered queries: one per operator, over the whole derived catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text, values
from shelfmark.operators import filters, ingest, joins, metrics, ordering, policy, upsert
from shelfmark.operators import jobs as job_ops
from shelfmark.operators import resolve as resolve_ops
from shelfmark.operators import search as search_ops
from shelfmark.plans import ingest as ingest_plan
from shelfmark.plans import prefetch, search, tables
from shelfmark.plans import resolve as resolve_plan
from shelfmark.schemas import CONNECTORS, CURSOR, EVENTS, JOBS, SIGNALS, Settings
from shelfmark.session import literal_frame, materialize, shared_dir
from shelfmark.sources import catalog, logs, stored_index
from shelfmark.sources.conform import conform
from shelfmark.streaming import streams

AS_OF = tables.AS_OF
QUERY = "tion der"
Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _hits(spark, sf):
    """All hits of the fixed query, as ``(id, score)``."""
    docs = tables.docs(spark, sf)
    score = text.match_score(F.col("content"), QUERY.split())
    return docs.select(F.col("dataset_id").alias("id"), score.alias("score")).filter("score > 0")


def _json_lists(df: DataFrame) -> DataFrame:
    """Lists as JSON text, so a result compares by plain values."""
    lists = [n for n, t in df.dtypes if t == "array<string>"]
    return df.withColumns({n: text.json_text_list(F.col(n)) for n in lists})


# Sources and sinks


@query
def load_catalog(spark, sf):
    raw = tables.datasets(spark, sf).select(
        "id", "source", "title", "description", "readme_text", "tags", "modalities",
        "license_class", "access_class", "size_class", "languages",
        F.parse_json("quality_signals").alias("quality_signals"),
    )
    stored = tables.artifacts(spark, sf).select(
        "dataset_id", "kind", F.parse_json("payload").alias("payload")
    )
    path = shared_dir(spark, "load_catalog")
    # Many catalog files, of about 200 records each whatever the size of the catalog.
    files = max(1, raw.count() // 200)
    by = F.pmod(F.hash("id"), F.lit(files)).alias("file")
    listed = raw.groupBy(by).agg(F.collect_list(F.struct(*raw.columns)).alias("datasets"))
    made = stored.withColumn("id", F.col("dataset_id")).groupBy(by).agg(
        F.collect_list(F.struct(*stored.columns)).alias("artifacts")
    )
    listed.join(made, "file", "left").write.partitionBy("file").json(f"{path}/files")
    datasets, artifacts = catalog.load_catalog(spark, f"{path}/files", AS_OF)
    schemas = artifacts.filter("kind = 'schema'").select(
        F.col("dataset_id").alias("id"), F.lit(True).alias("has_schema")
    ).distinct()
    has_schema = schemas.join(
        artifacts.groupBy(F.col("dataset_id").alias("id")).agg(
            F.array_join(F.sort_array(F.collect_list("payload")), "|").alias("payloads")
        ), "id",
    )
    return datasets.join(has_schema, "id", "left").select(
        "id", "source", "ns_local_id", "access_class", "fingerprint", "indexed_at",
        "readme_tokens", F.round("readme_score", 9).alias("readme_score"),
        F.coalesce("has_schema", F.lit(False)).alias("has_schema"), "payloads",
        F.md5("readme_text").alias("readme_md5"),
    )


@query
def conform_schema(spark, sf):
    e = tables.read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_type").alias("state"), F.col("value").alias("attempts"), "props",
        F.col("ts").alias("enqueued_at"),
    )
    return conform(e, JOBS)


def _cursor(spark):
    return literal_frame(spark, [tables.CURSOR], CURSOR)


@query
def ingest_listing(spark, sf):
    return _ingested(spark, sf, limit=500)


def _ingested(spark, sf, **how):
    rows, cursor = ingest_plan.ingest_listing(tables.listing(spark, sf), _cursor(spark), AS_OF, **how)
    picked = cursor.select(F.struct("lm", "id").alias("c")).scalar()
    return rows.withColumn("cursor", picked).select(
        "id", "title", "fingerprint", "last_seen_lm", "access_class", "license_class",
        F.col("cursor.lm").alias("cursor_lm"), F.col("cursor.id").alias("cursor_id"),
    )


@query
def ingest_listing_all(spark, sf):
    """All rows of the listing after the cursor."""
    return _ingested(spark, sf)


@query
def ingest_backfill(spark, sf):
    """All rows after the cursor that changed in the last three days."""
    return _ingested(spark, sf, backfill_until=ingest.backfill_start(AS_OF, 3))


def _discovered(spark, sf, limit=500, window_days=None):
    connectors = literal_frame(spark, [("hf", {"max_seen": dict(zip(("lm", "id"), tables.CURSOR))}, 3, None)], CONNECTORS)
    catalog_now = ingest_plan.Catalog(
        tables.datasets(spark, sf), tables.artifacts(spark, sf), connectors, tables.docs(spark, sf)
    )
    return ingest_plan.discover(
        catalog_now, tables.listing(spark, sf), AS_OF, limit=limit, window_days=window_days
    )


@query
def discovery_job(spark, sf):
    """One run over the stored catalog: documents, events, stale marks and cursor after it."""
    return _outcome(_discovered(spark, sf))


@query
def discovery_full(spark, sf):
    """One run to the end of the listing."""
    return _outcome(_discovered(spark, sf, limit=None))


@query
def discovery_backfill(spark, sf):
    """One run over what changed in the last seven days."""
    return _outcome(_discovered(spark, sf, limit=None, window_days=7))


def _outcome(run):
    seen = F.col("cursor.max_seen")
    docs = run.catalog.docs.select(
        F.lit("doc").alias("part"), F.col("dataset_id").alias("id"), F.md5("content").alias("detail")
    )
    events = run.events.select(F.lit("event").alias("part"), F.col("dataset_id").alias("id"), F.col("type").alias("detail"))
    stale = run.catalog.artifacts.filter("stale").select(
        F.lit("stale").alias("part"), F.col("dataset_id").alias("id"), F.col("kind").alias("detail")
    )
    rows = run.catalog.datasets.select(F.lit("dataset").alias("part"), "id", F.col("fingerprint").alias("detail"))
    moved = run.catalog.connectors.select(
        F.lit("cursor").alias("part"), seen["id"].alias("id"), F.date_format(seen["lm"], "yyyy-MM-dd HH:mm:ss").alias("detail")
    )
    return docs.unionByName(events).unionByName(stale).unionByName(rows).unionByName(moved)


@query
def update_index(spark, sf):
    """The stored index after a discovery run, by an update with the touched documents only."""
    path = shared_dir(spark, "index")
    run = _discovered(spark, sf)
    before = tables.docs(spark, sf)
    touched = run.ids.select(F.col("id").alias("dataset_id"))
    stored_index.write_inverted_index(before, path, 16)
    stored_index.update_inverted_index(
        before.join(touched, "dataset_id", "left_semi"),
        run.catalog.docs.join(touched, "dataset_id", "left_semi"), path, 1, 16,
    )
    return _index_rows(stored_index.read_inverted_index(spark, path, 16))


@query
def index_after_updates(spark, sf):
    """The stored index after all changes of a run to the end of the listing, in five updates,
    of which the first four are merged."""
    path = shared_dir(spark, "index")
    run = _discovered(spark, sf, limit=None)
    touched = materialize(run.ids.select(F.col("id").alias("dataset_id")), "touched")
    before, after = (
        materialize(d.join(touched, "dataset_id", "left_semi"), "changed")
        for d in (tables.docs(spark, sf), run.catalog.docs)
    )
    stored_index.write_inverted_index(tables.docs(spark, sf), path, 16)
    for version in range(1, 6):
        mine = F.pmod(F.xxhash64("dataset_id"), F.lit(5)) == version - 1
        stored_index.update_inverted_index(before.filter(mine), after.filter(mine), path, version, 16)
    return _index_rows(stored_index.read_inverted_index(spark, path, 16))


def _index_rows(index):
    totals = index.corpus.select(
        F.lit(None).cast("string").alias("term"), F.lit(None).cast("string").alias("dataset_id"),
        F.lit(None).cast("int").alias("tf"), F.lit(None).cast("int").alias("dl"),
        F.col("docs").alias("df"), F.round("avgdl", 6).alias("avgdl"),
    )
    nothing = F.lit(None).cast("double").alias("avgdl")
    return (
        index.postings.select("term", "dataset_id", "tf", "dl").join(index.terms.select("term", "df"), "term")
        .withColumn("avgdl", nothing).unionByName(totals)
    )


@query
def index_terms(spark, sf):
    """The document frequencies and the corpus row of the stored index."""
    index = tables.index(spark, sf)
    corpus = index.corpus.select(
        F.lit(None).cast("string").alias("term"), F.col("docs").alias("df"), F.round("avgdl", 6).alias("avgdl")
    )
    return index.terms.select("term", "df", F.lit(None).cast("double").alias("avgdl")).unionByName(corpus)


@query
def append_events(spark, sf):
    e = tables.read(spark, sf, "events")
    old = e.select(
        F.concat(F.lit("old-"), F.col("event_id").cast("string")).alias("id"),
        F.col("event_type").alias("type"), F.lit("{}").alias("payload"), F.col("ts").alias("created_at"),
    )
    new = e.select(
        F.concat(F.lit("new-"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("type"),
        F.concat(F.lit("ds/"), F.col("user_id").cast("string")).alias("dataset_id"),
        F.when(F.col("user_id") > 50, F.col("ts")).alias("created_at"),
        F.col("user_id"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("rank"),
    )
    return logs.append_events(conform(old, EVENTS), new, AS_OF)


@query
def append_signals(spark, sf):
    old = tables.signals(spark, sf)
    e = tables.read(spark, sf, "events")
    again = tables.signal_columns(e).withColumn(
        "created_at", F.when(F.col("event") != "error", F.col("created_at"))
    )
    return logs.append_signals(old, again, AS_OF)


# Filters, lookups, projections


@query
def filter_license(spark, sf):
    return filters.by_license(tables.datasets(spark, sf), "mit").select("id", "license_class")


@query
def filter_size(spark, sf):
    return filters.by_size(tables.datasets(spark, sf), "1M<n<10M").select("id", "size_class")


@query
def filter_modality(spark, sf):
    hit = filters.by_modality(tables.datasets(spark, sf), "MAGE")
    return _json_lists(hit.select("id", "modalities"))


@query
def filter_language(spark, sf):
    d = tables.datasets(spark, sf)
    like = filters.by_language(d, "E").select("id", "languages", F.lit("like").alias("mode"))
    exact = filters.by_language(d, "en", "exact").select("id", "languages", F.lit("exact").alias("mode"))
    return _json_lists(like.unionByName(exact))


@query
def lookup_datasets(spark, sf):
    wanted = tables.requests(spark, sf).select(F.col("dataset_id").alias("id")).distinct()
    found = filters.lookup_datasets(tables.datasets(spark, sf), wanted)
    return found.select("id", "title", "license_class", "readme_tokens", "last_seen_lm")


@query
def lookup_artifacts(spark, sf):
    wanted = tables.requests(spark, sf)
    return filters.lookup_artifacts(tables.artifacts(spark, sf), wanted)


@query
def thin_readme(spark, sf):
    d = tables.datasets(spark, sf).withColumn(
        "readme_score", F.when(F.col("ns_local_id").cast("bigint") % 6 != 0, F.col("readme_score"))
    )
    return filters.thin_datasets(d).select("id", "readme_tokens")


@query
def fresh_artifacts(spark, sf):
    return filters.fresh_artifacts(tables.artifacts(spark, sf)).select("dataset_id", "kind", "created_at")


@query
def recency_filter(spark, sf):
    e = tables.read(spark, sf, "events")
    return e.filter(values.since(F.col("ts"), AS_OF, 7)).select(
        "event_id", values.since(F.col("ts"), AS_OF, 1, strict=True).alias("last_day")
    )


@query
def search_hit_projection(spark, sf):
    hits = filters.hit_projection(tables.datasets(spark, sf))
    return _json_lists(hits).withColumn("readme_text", F.md5("readme_text"))


@query
def display_description(spark, sf):
    return filters.display_description(tables.datasets(spark, sf))


@query
def size_label(spark, sf):
    d = tables.datasets(spark, sf)
    return d.select("id", values.size_label(F.col("size_class")).alias("label"))


# Joins


@query
def join_search_catalog(spark, sf):
    d = tables.datasets(spark, sf)
    joined = joins.join_docs(tables.docs(spark, sf), d)
    return joined.select("id", "title", F.length("content").alias("content_chars"))


@query
def schema_flag(spark, sf):
    d = tables.datasets(spark, sf).select("id")
    return joins.with_schema_flag(d, tables.artifacts(spark, sf))


@query
def state_view_join(spark, sf):
    return joins.state_join(
        tables.datasets(spark, sf), tables.artifacts(spark, sf), tables.jobs(spark, sf), AS_OF
    )


@query
def anti_no_schema(spark, sf):
    return joins.without_schema(tables.datasets(spark, sf), tables.artifacts(spark, sf)).select("id")


@query
def signal_score_join(spark, sf):
    d = tables.datasets(spark, sf).select("id")
    return joins.with_signal_score(d, tables.signals(spark, sf), AS_OF)


@query
def fts_join(spark, sf):
    terms = tables.queries(spark).transform(search_ops.query_terms)
    return search_ops.postings_join(tables.index(spark, sf), terms).select("query_id", "term", "dataset_id", "tf")


@query
def like_match_join(spark, sf):
    words = search_ops.query_words(tables.queries(spark))
    return search_ops.like_join(tables.docs(spark, sf), words)


@query
def covered_public_join(spark, sf):
    return joins.covered_public(tables.datasets(spark, sf), tables.artifacts(spark, sf)).select("id")


@query
def request_planning_join(spark, sf):
    return joins.request_join(
        tables.requests(spark, sf), tables.artifacts(spark, sf), tables.datasets(spark, sf)
    ).select("request_id", "dataset_id", "kind", "stale", "has_artifact", "known", "license_class")


# Aggregations


@query
def dataset_state(spark, sf):
    return metrics.dataset_state(
        tables.datasets(spark, sf), tables.artifacts(spark, sf), tables.jobs(spark, sf), AS_OF
    )


@query
def job_counts_by_state(spark, sf):
    return metrics.jobs_by_state(tables.jobs(spark, sf))


@query
def error_taxonomy(spark, sf):
    return metrics.error_taxonomy(tables.jobs(spark, sf))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n, t in df.dtypes if t == "double"})


@query
def freshness_pct(spark, sf):
    return _rounded(metrics.freshness_pct(tables.datasets(spark, sf), AS_OF))


@query
def thin_readme_pct(spark, sf):
    return _rounded(metrics.thin_readme_pct(tables.datasets(spark, sf)))


@query
def schema_coverage(spark, sf):
    return _rounded(metrics.schema_coverage(tables.datasets(spark, sf), tables.artifacts(spark, sf)))


@query
def queue_depth(spark, sf):
    return metrics.queue_depth(tables.jobs(spark, sf))


@query
def resolve_p95_ms(spark, sf):
    return _rounded(metrics.resolve_p95(tables.jobs(spark, sf)))


def _metrics(spark, sf):
    return metrics.admin_metrics(
        tables.datasets(spark, sf), tables.artifacts(spark, sf), tables.jobs(spark, sf), AS_OF
    )


@query
def admin_metrics(spark, sf):
    row = metrics.pause_reason(_metrics(spark, sf))
    return _rounded(
        row.withColumns(
            {"jobs_by_state": F.to_json("jobs_by_state"), "error_taxonomy": F.to_json("error_taxonomy")}
        )
    )


@query
def signal_popularity(spark, sf):
    return joins.signal_popularity(tables.signals(spark, sf), AS_OF)


@query
def search_total(spark, sf):
    return metrics.search_total(_hits(spark, sf))


@query
def page_stats(spark, sf):
    d = joins.with_schema_flag(tables.datasets(spark, sf), tables.artifacts(spark, sf))
    return metrics.page_stats(d.join(_hits(spark, sf), "id", "left_semi"))


@query
def facet_values(spark, sf):
    d = tables.datasets(spark, sf)
    return metrics.facet_values(d.join(_hits(spark, sf), "id", "left_semi"))


@query
def distinct_schema_ids(spark, sf):
    return joins.distinct_schema_ids(tables.artifacts(spark, sf))


# Ordering


@query
def assign_docid(spark, sf):
    return ordering.assign_docid(tables.datasets(spark, sf).select("id"))


@query
def rank_hits(spark, sf):
    return ordering.rank_hits(_hits(spark, sf), 30, 10)


@query
def rank_hits_batch(spark, sf):
    queries = tables.queries(spark)
    words = search_ops.query_words(queries)
    scored = search.like_scores(tables.docs(spark, sf), words)
    hits = scored.join(queries.select("query_id", "limit", "offset"), "query_id")
    ranked = ordering.rank_hits_batch(hits, search.deepest_row(queries))
    return ranked.select("query_id", "id", "score", "rn")


@query
def prefetch_order(spark, sf):
    d = tables.datasets(spark, sf).select(
        "id", "last_seen_lm",
        values.json_bigint(F.col("quality_signals"), "downloads").alias("downloads"),
    )
    ranked = joins.with_signal_score(d, tables.signals(spark, sf), AS_OF)
    return ordering.prefetch_order(ranked, 50)


@query
def due_jobs(spark, sf):
    return ordering.due_jobs(tables.jobs(spark, sf), 100).select("id", "enqueued_at")


# Scalar functions


@query
def search_content(spark, sf):
    d = tables.datasets(spark, sf)
    return d.select("id", F.md5(text.search_content(d)).alias("content_md5"))


@query
def query_tokens(spark, sf):
    c = tables.read(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", F.array_join(text.query_tokens(F.col("text")), "|").alias("tokens")
    )


@query
def token_count(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id")
    return d.select("doc_id", text.token_count(F.col("text")).alias("tokens"))


def _doc_scores(spark, sf, score):
    d = tables.read(spark, sf, "documents", "doc_id")
    return d.select("doc_id", F.round(score(text.token_count(F.col("text"))), 9).alias("score"))


@query
def readme_score_log(spark, sf):
    return _doc_scores(spark, sf, text.score_log)


@query
def readme_score_linear(spark, sf):
    return _doc_scores(spark, sf, text.score_linear)


@query
def readme_headings(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id")
    # No given text has headings: German ones get one on top, French ones lower down.
    readme = (
        F.when(F.col("lang") == "de", F.concat(F.lit("\n## Titel #"), F.col("source"), F.lit(" \r\n"), F.col("text")))
        .when(F.col("lang") == "fr", F.concat(F.lit("###\n"), F.regexp_replace("text", "\n", "\n# ")))
        .otherwise(F.col("text"))
    )
    found = text.readme_headings(readme)
    return d.select("doc_id", found["title"].alias("title"), found["description"].alias("description"))


@query
def fingerprint(spark, sf):
    return tables.datasets(spark, sf).select("id", "fingerprint")


@query
def json_text_list(spark, sf):
    d = tables.read(spark, sf, "documents", "doc_id")
    lines = F.split("text", "\n")
    odd = F.array(F.col("lang"), F.lit('say "hi"'), F.lit("a\\b\té"))
    return d.select(
        "doc_id", F.md5(text.json_text_list(F.concat(lines, odd))).alias("listed_md5"),
        text.json_text_list(F.when(F.col("doc_id") % 3 > 0, odd)).alias("listed"),
    )


@query
def json_parse_list(spark, sf):
    d = tables.datasets(spark, sf)
    raw = (
        F.when(F.col("access_class") == "private", "[broken")
        .when(F.col("license_class") == "mit", "")
        .otherwise(text.json_text_list(F.col("tags")))
    )
    parsed = text.json_parse_list(raw)
    return d.select(
        "id", F.size(parsed).cast("bigint").alias("items"), F.array_join(parsed, "|").alias("joined")
    ).withColumn("items", F.when(F.col("items") >= 0, F.col("items")))


@query
def json_get_bigint(spark, sf):
    d = tables.datasets(spark, sf)
    quality = F.col("quality_signals")
    return d.select(
        "id", values.json_bigint(quality, "downloads").alias("downloads"),
        values.json_bigint(quality, "likes").alias("likes"),
    )


@query
def why_tokens(spark, sf):
    d = tables.datasets(spark, sf)
    asked = text.query_tokens(F.lit("Tion der the tion lang:en zzz"))
    return d.select(
        "id", F.array_join(text.why_tokens(asked, text.search_content(d)), "|").alias("why")
    )


@query
def parse_last_modified(spark, sf):
    return tables.listing(spark, sf).select("id", values.parse_lm(F.col("last_modified")).alias("lm"))


@query
def iso_format(spark, sf):
    e = tables.read(spark, sf, "events")
    return e.select(
        "event_id", values.iso_format(F.col("ts")).alias("iso"),
        values.iso_format(F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("iso_hour"),
    )


@query
def ns_local_id(spark, sf):
    return tables.listing(spark, sf).select("id", values.ns_local_id(F.col("id")).alias("local_id"))


@query
def size_rank(spark, sf):
    d = tables.datasets(spark, sf)
    size = F.when(F.col("access_class") == "public", F.col("size_class"))
    odd = F.when(F.col("license_class") == "mit", "huge").otherwise(size)
    return d.select("id", values.size_rank(odd).alias("rank"))


@query
def truncate_detail(spark, sf):
    c = tables.read(spark, sf, "conversations")
    return c.select(
        "conv_id", "turn", values.truncate_detail(F.col("text"), 500).alias("event_detail"),
        F.md5(values.truncate_detail(F.col("text"), 2000)).alias("job_detail_md5"),
    )


@query
def budget_flags(spark, sf):
    r = tables.requests(spark, sf)
    elapsed = F.length("request_id") * 150
    flags = values.budget_flags(F.col("budget_ms"), F.col("row_cap") - 100, elapsed)
    return r.select("request_id", flags.alias("f")).select("request_id", "f.*")


@query
def access_class(spark, sf):
    listing = tables.listing(spark, sf)
    return listing.select("id", values.access_class(F.col("private")).alias("access_class"))


# Search


@query
def build_search_docs(spark, sf):
    docs = search_ops.build_search_docs(tables.datasets(spark, sf))
    return docs.select("dataset_id", F.md5("content").alias("content_md5"))


def _hit_columns(hits: DataFrame) -> DataFrame:
    return _json_lists(hits).withColumn("readme_text", F.md5("readme_text"))


@query
def search_like(spark, sf):
    d = tables.datasets(spark, sf)
    hits, total = search.search_like(
        tables.docs(spark, sf), d, tables.artifacts(spark, sf), QUERY
    )
    return _hit_columns(hits).withColumn("total", total.scalar())


@query
def search_bm25(spark, sf):
    d = tables.datasets(spark, sf)
    hits, total = search.search_bm25(
        tables.index(spark, sf), d, tables.artifacts(spark, sf), QUERY, {"modality": "image"}, limit=20, offset=3
    )
    return _hit_columns(hits).withColumn("total", total.scalar())


@query
def search_batch(spark, sf):
    d = tables.datasets(spark, sf)
    found = search.search_batch(
        tables.docs(spark, sf), d, tables.artifacts(spark, sf), tables.queries(spark)
    )
    return _json_lists(found)


@query
def like_match_many(spark, sf):
    """Every word of the benchmark texts as a search token, thousands at once."""
    words = tables.read(spark, sf, "benchmark").select(
        F.explode(text.query_tokens(F.col("text"))).alias("token")
    )
    return search_ops.like_join(tables.docs(spark, sf), words).select("token", "dataset_id")


@query
def search_with_fallback(spark, sf):
    d = tables.datasets(spark, sf)
    found = search.search_with_fallback(
        tables.index(spark, sf), tables.docs(spark, sf), d, tables.artifacts(spark, sf),
        tables.queries(spark),
    )
    return _json_lists(found)


@query
def build_inverted_index(spark, sf):
    path = shared_dir(spark, "index")
    stored_index.write_inverted_index(tables.docs(spark, sf), path, tables.INDEX_BUCKETS)
    return spark.read.parquet(f"{path}/postings").select("term", "dataset_id", "tf", "dl")


# Ingest and upsert


@query
def cursor_filter(spark, sf):
    rows = ingest.with_lm(tables.listing(spark, sf))
    return ingest.after_cursor(rows, _cursor(spark)).select("id", "lm")


@query
def backfill_filter(spark, sf):
    rows = ingest.with_lm(tables.listing(spark, sf))
    return ingest.backfill(rows, AS_OF, 3).select("id", "lm")


@query
def listing_top_n(spark, sf):
    rows = ingest.with_lm(tables.listing(spark, sf))
    return ingest.newest(rows, 500).select("id", "lm")


@query
def listing_to_dataset(spark, sf):
    rows = ingest.listing_to_datasets(ingest.with_lm(tables.listing(spark, sf)), AS_OF)
    quality = F.col("quality_signals")
    return _json_lists(
        rows.select(
            "id", "source", "ns_local_id", "title", "tags", "license_class", "access_class",
            "last_seen_lm", "fingerprint", "indexed_at", "readme_tokens", "readme_score",
            values.json_bigint(quality, "downloads").alias("downloads"),
            values.json_bigint(quality, "likes").alias("likes"),
            F.get_json_object(quality, "$.gated").alias("gated"),
        )
    )


@query
def next_cursor(spark, sf):
    rows = ingest.with_lm(tables.listing(spark, sf))
    return ingest.next_cursor(rows.select("lm", "id"), _cursor(spark))


@query
def upsert_datasets(spark, sf):
    merged = upsert.upsert_datasets(tables.stored_datasets(spark, sf), tables.new_batch(spark, sf))
    return merged.select(
        "id", "source", "title", "fingerprint", "license_class", "readme_tokens", "last_seen_lm",
        F.md5("readme_text").alias("readme_md5"),
    )


@query
def detect_changes(spark, sf):
    events = upsert.detect_changes(
        tables.stored_datasets(spark, sf), tables.new_batch(spark, sf), AS_OF
    )
    return events.select(
        "type", "dataset_id", "created_at",
        F.get_json_object("payload", "$.fingerprint_old").alias("fingerprint_old"),
        F.get_json_object("payload", "$.fingerprint_new").alias("fingerprint_new"),
    )


@query
def mark_stale(spark, sf):
    changed = upsert.changed_ids(tables.stored_datasets(spark, sf), tables.new_batch(spark, sf))
    return upsert.mark_stale(tables.artifacts(spark, sf), changed).select("dataset_id", "kind", "stale")


@query
def upsert_artifacts(spark, sf):
    new = tables.jobs(spark, sf).filter("state = 'done'").select(
        "dataset_id", "kind", F.concat(F.lit('{"job":"'), "id", F.lit('"}')).alias("payload"),
        F.col("started_at").alias("created_at"), F.lit(False).alias("stale"),
        F.substring_index("id", "-", -1).cast("bigint").alias("batch_pos"),
    )
    return upsert.upsert_artifacts(tables.artifacts(spark, sf), new)


@query
def merge_connector_state(spark, sf):
    """Connectors by source, before and after the labelled datasets were listed again."""
    def by_source(d, limit, backoff):
        seen = F.max(F.struct(F.col("last_seen_lm").alias("lm"), "id"))
        return d.groupBy("source").agg(
            F.struct(seen.alias("max_seen")).alias("cursor"),
            limit.alias("qps_limit"), backoff.alias("backoff_state"),
        )

    d = tables.datasets(spark, sf).filter(F.col("last_seen_lm").isNotNull())
    old = by_source(d, F.max("readme_tokens"), F.lit('{"wait":1}'))
    labelled = tables.artifacts(spark, sf).select(F.col("dataset_id").alias("id"))
    suffix = F.when(F.col("access_class") == "private", "-p").otherwise("")
    again = (
        d.join(labelled, "id", "left_semi")
        .filter("license_class = 'mit'")
        .withColumn("source", F.concat("source", suffix))
    )
    new = by_source(again, F.when(F.count("description") > 2, 5), F.lit(None).cast("string"))
    merged = upsert.merge_connectors(old, new)
    return merged.select(
        "source", F.col("cursor.max_seen.lm").alias("lm"), F.col("cursor.max_seen.id").alias("seen_id"),
        "qps_limit", "backoff_state",
    )


# Policy, resolve, jobs


def _judged(spark, sf, settings=Settings()):
    found = joins.request_join(
        tables.requests(spark, sf), tables.artifacts(spark, sf), tables.datasets(spark, sf)
    )
    return policy.policy_eval(policy.with_effective_budget(found, settings), settings)


@query
def policy_eval(spark, sf):
    settings = replace(Settings(), max_size_class="1M<n<10M")
    return _judged(spark, sf, settings).select("request_id", "allow", "reason_code")


@query
def effective_budget(spark, sf):
    r = policy.with_effective_budget(tables.requests(spark, sf))
    return r.select("request_id", "budget_ms", "row_cap")


@query
def plan_resolves(spark, sf):
    cached, blocked, jobs, events = resolve_plan.plan_resolves(
        tables.requests(spark, sf), tables.artifacts(spark, sf), tables.datasets(spark, sf), AS_OF
    )
    asked = events.select(
        F.lit("event").alias("part"), F.get_json_object("payload", "$.job_id").alias("id"),
        "dataset_id", F.col("type").alias("detail"),
        F.get_json_object("payload", "$.budget_ms").cast("int").alias("budget_ms"),
    )
    return (
        cached.select(F.lit("cached").alias("part"), F.col("request_id").alias("id"),
                      F.lit(None).cast("string").alias("dataset_id"), F.col("job_id").alias("detail"),
                      F.lit(None).cast("int").alias("budget_ms"))
        .unionByName(blocked.select(F.lit("blocked").alias("part"), F.col("request_id").alias("id"),
                                    "dataset_id", F.col("reason_code").alias("detail"),
                                    F.lit(None).cast("int").alias("budget_ms")))
        .unionByName(jobs.select(F.lit("job").alias("part"), "id", "dataset_id",
                                 F.col("state").alias("detail"), "budget_ms"))
        .unionByName(asked)
    )


@query
def infer_schema(spark, sf):
    fields = resolve_ops.infer_schema(tables.sample_rows(spark, sf))
    return fields.withColumn("examples", F.array_join("examples", ";"))


def _info(spark, sf):
    """Dataset infos, one per labelled document: by its id some declare features in a
    split, some on top, some name no split at all."""
    n = F.col("doc_id")
    split = F.concat(
        F.lit('{"config":"c'), (n % 3).cast("string"), F.lit('","split":"train","features":'),
        F.when(n % 4 == 0, F.concat(F.lit('[{"name":"f'), n.cast("string"), F.lit('","dtype":"string"}]'))).otherwise("[]"),
        F.lit("}"),
    )
    body = F.concat(
        F.lit('{"dataset_id":"ds/'), n.cast("string"), F.lit('","splits":['),
        F.lit('{"config":"c0","split":"test"},'), split, F.lit("]"),
        F.when(n % 5 == 0, ',"default_config":"main"').otherwise(""),
        F.when(n % 6 == 1, ',"features":[{"name":"top"}]').otherwise(""), F.lit("}"),
    )
    bare = F.concat(F.lit('{"dataset_id":"ds/'), n.cast("string"), F.lit('"}'))
    labels = tables.read(spark, sf, "labels")
    return labels.select(
        F.from_json(F.when(n % 7 == 0, bare).otherwise(body), resolve_ops.INFO).alias("i")
    ).select("i.*")


def _cards(spark, sf):
    n = F.col("doc_id")
    features = (
        F.when(n % 3 == 0, '{"text":{"dtype":"string"},"label":"int64"}')
        .when(n % 3 == 1, F.concat(F.lit('[{"name":"c'), n.cast("string"), F.lit('"}]')))
    )
    card = F.when(
        features.isNotNull(),
        F.concat(F.lit('{"dataset_info":{"features":'), features, F.lit("}}")),
    ).otherwise("{}")
    return tables.read(spark, sf, "labels").select(
        F.concat(F.lit("ds/"), n.cast("string")).alias("dataset_id"), card.alias("card_json")
    )


@query
def features_from_info(spark, sf):
    return resolve_ops.features_from_info(_info(spark, sf))


@query
def features_from_card(spark, sf):
    return resolve_ops.features_from_card(_cards(spark, sf))


@query
def resolve_schemas(spark, sf):
    """Jobs of all events; a dataset's sample rows are the events of its user."""
    user = F.concat(F.lit("ds/"), F.col("user_id").cast("string"))
    rows = tables.read(spark, sf, "events").select(
        user.alias("dataset_id"), F.col("event_id").alias("row_idx"),
        F.concat(F.lit('{"id":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.lit("}")).alias("row_json"),
    )
    # Every second job asks for two rows only, which leaves its fields fewer examples.
    own = F.when(F.substring_index("id", "-", -1).cast("bigint") % 2 == 0, 2).otherwise(F.col("row_cap"))
    jobs = tables.jobs(spark, sf).withColumn("row_cap", own)
    solved = resolve_plan.resolve_schemas(jobs, _info(spark, sf), rows, _cards(spark, sf))
    plain = ["config", "split", "note", "source", "kind", "schema"]
    numbers = ["row_cap_applied", "fetched_ms", "budget_ms_requested"]
    return solved.select(
        "job_id", "dataset_id",
        *[F.get_json_object("payload", f"$.{name}").alias(name) for name in plain],
        *[F.get_json_object("payload", f"$.{name}").cast("int").alias(name) for name in numbers],
        F.get_json_object("payload", "$.budget_exhausted").cast("boolean").alias("budget_exhausted"),
    )


@query
def classify_error(spark, sf):
    e = tables.read(spark, sf, "events")
    kind, status = _failure()
    return e.select("event_id", resolve_ops.classify_error(kind, status).alias("error_class"))


def _failure():
    n = F.col("event_id")
    kind = (
        F.when(n % 6 == 0, "timeout").when(n % 6 < 3, "http_status").when(n % 6 == 3, "connection")
        .when(n % 6 == 4, "value").otherwise("other")
    )
    status = F.when(n % 5 == 0, 429).when(n % 5 == 1, 503).when(n % 5 == 2, 404).when(n % 5 == 3, 600)
    return kind, status


def _applied(spark, sf):
    kind, status = _failure()
    outcomes = tables.read(spark, sf, "events").filter("event_type = 'view'").select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        (F.col("event_id") % 3 > 0).alias("ok"),
        F.col("props").alias("payload"),
        resolve_ops.classify_error(kind, status).alias("error_class"),
        F.repeat("props", 300).alias("error_detail"),
    )
    return resolve_ops.apply_outcomes(tables.jobs(spark, sf), outcomes, AS_OF)


@query
def apply_outcomes(spark, sf):
    jobs, artifacts, events = _applied(spark, sf)
    return (
        jobs.select(
            F.lit("job").alias("part"), "id", F.col("state").alias("kind"), "attempts",
            F.col("error_class").alias("text"), F.length("error_detail").alias("chars"),
            F.col("finished_at").alias("at"),
        )
        .unionByName(
            artifacts.select(
                F.lit("artifact").alias("part"), F.col("dataset_id").alias("id"), "kind",
                F.lit(None).cast("int").alias("attempts"), F.col("payload").alias("text"),
                F.lit(None).cast("int").alias("chars"), F.col("created_at").alias("at"),
            )
        )
        .unionByName(
            events.select(
                F.lit("event").alias("part"), F.get_json_object("payload", "$.job_id").alias("id"),
                F.col("type").alias("kind"), F.lit(None).cast("int").alias("attempts"),
                F.get_json_object("payload", "$.error_class").alias("text"),
                F.length(F.get_json_object("payload", "$.error_detail")).alias("chars"),
                F.col("created_at").alias("at"),
            )
        )
    )


@query
def upsert_jobs(spark, sf):
    old = tables.jobs(spark, sf)
    turns = F.explode(F.array(F.lit(1), F.lit(2)))
    new = (
        old.filter("state = 'error'").withColumn("batch_pos", turns)
        .withColumn("state", F.when(F.col("batch_pos") == 2, "queued").otherwise("running"))
        .withColumn("error_class", F.lit(None).cast("string"))
    )
    return upsert.upsert_jobs(old, new).select("id", "state", "error_class", "attempts", "started_at")


@query
def reclaim_stale(spark, sf):
    moment = datetime(2024, 1, 20)
    done = job_ops.reclaim_stale(tables.jobs(spark, sf), moment, 30.0)
    return done.select("id", "state", "started_at", "finished_at")


@query
def start_jobs(spark, sf):
    return job_ops.start_jobs(tables.jobs(spark, sf), 150, AS_OF).select("id", "state", "started_at")


@query
def pause_reason(spark, sf):
    settings = replace(Settings(), queue_depth_max=1000)
    row = metrics.pause_reason(_metrics(spark, sf), settings)
    return row.select("queue_depth", "prefetch_paused", "prefetch_reason")


def _candidates(spark, sf, limit=100):
    return prefetch.prefetch_candidates(
        tables.datasets(spark, sf), tables.artifacts(spark, sf), tables.signals(spark, sf), AS_OF, limit
    )


@query
def prefetch_candidates(spark, sf):
    return _candidates(spark, sf).select("id", "sig_score", "downloads", "last_seen_lm")


@query
def prefetch_jobs(spark, sf):
    settings = replace(Settings(), queue_depth_max=10**9, resolve_p95_max_ms=10**9)
    merged = prefetch.prefetch_jobs(
        _candidates(spark, sf, 20), _metrics(spark, sf), tables.jobs(spark, sf), AS_OF, settings
    )
    return merged.select("id", "dataset_id", "kind", "state", "budget_ms", "enqueued_at")


# Streams


@query
def stream_signals(spark, sf):
    path = shared_dir(spark, "stream_signals")
    source = tables.signal_columns(streams.read_table(spark, sf, "events"))
    streams.stream_signals(source, f"{path}/out", f"{path}/ckpt", AS_OF).awaitTermination()
    return streams.read_log(spark, f"{path}/out", SIGNALS)


@query
def stream_signals_shuffled(spark, sf):
    """The same signals from files in an order unlike that of time, with repeats, in batches."""
    path = shared_dir(spark, "stream_signals")
    signals = tables.signal_columns(tables.read(spark, sf, "events"))
    n = F.substring_index("id", "-", -1).cast("bigint")
    mixed = signals.filter(n % 3 == 0).unionByName(signals)
    files = max(6, tables.read(spark, sf, "events").rdd.getNumPartitions())
    mixed.repartition(files, F.hash("id")).write.parquet(f"{path}/in")
    source = streams.read_folder(spark, f"{path}/in", -(-files // 3))
    streams.stream_signals(source, f"{path}/out", f"{path}/ckpt", AS_OF).awaitTermination()
    return streams.read_log(spark, f"{path}/out", SIGNALS)


@query
def stream_popularity(spark, sf):
    path = shared_dir(spark, "stream_popularity")
    source = tables.signal_columns(streams.read_table(spark, sf, "events"))
    streams.stream_popularity(source, f"{path}/out", f"{path}/ckpt").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query
def stream_upsert_datasets(spark, sf):
    """Streams the labelled documents as dataset rows into a stored catalog."""
    path = shared_dir(spark, "stream_datasets")
    tables.new_batch(spark, sf).write.parquet(f"{path}/in")
    source = streams.read_folder(spark, f"{path}/in")
    tables.stored_datasets(spark, sf).write.parquet(f"{path}/state/datasets/v00000001")
    streams.stream_upsert_datasets(source, f"{path}/state", f"{path}/ckpt", AS_OF).awaitTermination()
    merged = streams.current(spark, f"{path}/state", "datasets")
    return merged.select("id", "title", "fingerprint", "readme_tokens")


@query
def stream_upsert_effects(spark, sf):
    """What the same stream does to artifacts and writes to the change log."""
    path = shared_dir(spark, "stream_datasets")
    tables.new_batch(spark, sf).write.parquet(f"{path}/in")
    source = streams.read_folder(spark, f"{path}/in")
    tables.stored_datasets(spark, sf).write.parquet(f"{path}/state/datasets/v00000001")
    tables.artifacts(spark, sf).write.parquet(f"{path}/state/artifacts/v00000001")
    streams.stream_upsert_datasets(source, f"{path}/state", f"{path}/ckpt", AS_OF).awaitTermination()
    artifacts = streams.current(spark, f"{path}/state", "artifacts")
    events = streams.read_log(spark, f"{path}/state/events", EVENTS)
    return artifacts.select(
        F.lit("artifact").alias("part"), "dataset_id", F.col("kind").alias("what"), "stale"
    ).unionByName(
        events.select(F.lit("event").alias("part"), "dataset_id", F.col("type").alias("what"),
                      F.lit(None).cast("boolean").alias("stale"))
    )


@query
def stream_job_state(spark, sf):
    """Streams state records, one per event, keyed by the user's job."""
    path = shared_dir(spark, "stream_jobs")
    e = streams.read_table(spark, sf, "events")
    records = e.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"),
    )
    streams.stream_job_state(records, f"{path}/state", f"{path}/ckpt").awaitTermination()
    return streams.current_job_state(spark, f"{path}/state").select("id", "state", "at")
