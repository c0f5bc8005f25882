"""Merges, change detection, ingest, jobs, policy, metrics, prefetch."""

import json
import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from catalog_rows import NOW
from pyspark.sql import functions as F

from shelfmark.operators import filters, ingest, jobs as job_ops, joins, metrics, policy, upsert
from shelfmark.plans import prefetch
from shelfmark.plans import ingest as ingest_plan
from shelfmark.plans import resolve as resolve_plan
from shelfmark.schemas import DATASETS, Settings


def batch_of(spark, rows):
    """Dataset rows (id, fingerprint, title) in batch order."""
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "batch_pos long, id string, fingerprint string, title string"
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in DATASETS if f.name not in df.columns]
    return df.select("*", *empty)


BATCH = [
    ("lab/river-levels", "f1", "same"), ("lab/bird-calls", "x", "stored null"), ("lab/private-maps", None, "to null"),
    ("new", "n1", "first"), ("new", "n2", "second"), ("plain", None, "empty to null"),
]


def test_upsert_last_row_wins_and_nulls_overwrite(spark, catalog):
    merged = {r["id"]: r for r in upsert.upsert_datasets(catalog[0], batch_of(spark, BATCH)).collect()}
    assert len(merged) == 5 and merged["new"]["title"] == "second" and merged["new"]["fingerprint"] == "n2"
    assert merged["lab/river-levels"]["readme_text"] is None and merged["lab/private-maps"]["fingerprint"] is None


def test_change_events(spark, catalog):
    events = upsert.detect_changes(catalog[0], batch_of(spark, BATCH), NOW).collect()
    got = sorted((e["type"], e["dataset_id"], e["payload"]) for e in events)
    assert [(t, d) for t, d, _ in got] == [
        ("dataset.changed", "lab/private-maps"), ("dataset.changed", "plain"), ("dataset.discovered", "lab/bird-calls"),
        ("dataset.discovered", "new"), ("dataset.discovered", "new"),
    ]
    assert json.loads(got[0][2]) == {"fingerprint_old": "f3", "fingerprint_new": None}
    assert len({e["id"] for e in events}) == 5
    again = upsert.detect_changes(catalog[0], batch_of(spark, BATCH), NOW).collect()
    assert {e["id"] for e in again} == {e["id"] for e in events}


def test_stale_marks(spark, catalog):
    changed = upsert.changed_ids(catalog[0], batch_of(spark, BATCH))
    # A stored empty fingerprint against a missing one is an event but not a change of content.
    assert {r["id"] for r in changed.collect()} == {"lab/private-maps"}
    moved = upsert.changed_ids(catalog[0], batch_of(spark, [("lab/river-levels", "f2", "t")]))
    marks = {(r["dataset_id"], r["kind"]): r["stale"] for r in upsert.mark_stale(catalog[1], moved).collect()}
    assert marks["lab/river-levels", "schema"] is True and marks["lab/bird-calls", "schema"] is None
    assert len(marks) == 4


def test_merge_connectors(spark):
    schema = "source string, cursor struct<max_seen:struct<lm:timestamp_ntz,id:string>>, qps_limit int, backoff_state string"
    seen = lambda i: ((datetime(2024, 1, i), f"d{i}"),)
    old = spark.createDataFrame([("a", seen(1), 5, "{}"), ("b", seen(2), 6, None)], schema)
    new = spark.createDataFrame([("a", seen(3), None, None), ("c", None, 1, "{}"), ("b", None, 9, "{1}")], schema)
    got = {r["source"]: r for r in upsert.merge_connectors(old, new).collect()}
    assert got["a"]["cursor"]["max_seen"]["id"] == "d3" and got["a"]["qps_limit"] == 5 and got["a"]["backoff_state"] == "{}"
    assert got["b"]["cursor"] is None and got["b"]["qps_limit"] == 9 and len(got) == 3


LISTING = [
    ("b/2", "2024-01-05T00:00:00Z"), ("b/1", "2024-01-05T00:00:00Z"), ("b/3", "2024-01-05T00:00:00Z"),
    ("old", "2024-01-04T23:59:59Z"), ("new", "2024-01-06T00:00:00+00:00"), ("none", None), ("bad", "soon"),
]


def listing_of(spark):
    df = spark.createDataFrame(LISTING, "id string, last_modified string")
    for name, kind in (("tags", "array<string>"), ("license", "string"), ("private", "boolean"), ("downloads", "bigint"),
                       ("likes", "bigint"), ("gated", "boolean"), ("card_title", "string"), ("has_card", "boolean")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def cursor_of(spark, *rows):
    return spark.createDataFrame(list(rows), "lm timestamp_ntz, id string")


def test_cursor(spark):
    rows = ingest.with_lm(listing_of(spark))
    ids = lambda df: {r["id"] for r in df.collect()}
    assert ids(ingest.after_cursor(rows, (datetime(2024, 1, 5), "b/2"))) == {"b/3", "new"}
    assert ids(ingest.after_cursor(rows, cursor_of(spark, (datetime(2024, 1, 5), "b/2")))) == {"b/3", "new"}
    assert ids(ingest.after_cursor(rows, None)) == {"b/1", "b/2", "b/3", "old", "new"}
    assert ids(ingest.after_cursor(rows, cursor_of(spark, (None, "b/2")))) == {"b/1", "b/2", "b/3", "old", "new"}
    assert ids(ingest.after_cursor(rows, cursor_of(spark))) == {"b/1", "b/2", "b/3", "old", "new"}
    with pytest.raises(ValueError):
        ingest.backfill(rows, NOW, 2)


def test_limited_runs_see_every_row_once(spark):
    want = {r["id"] for r in ingest.with_lm(listing_of(spark)).collect()}
    cursor, seen = cursor_of(spark), []
    for _ in range(10):
        datasets, after = ingest_plan.ingest_listing(listing_of(spark), cursor, NOW, limit=1)
        seen += [r["id"] for r in datasets.collect()]
        cursor = cursor_of(spark, *[tuple(r) for r in after.collect()])
    assert sorted(seen) == sorted(want)


def test_repeated_ids_without_a_position_leave_one_row(spark, catalog):
    batch = batch_of(spark, BATCH).drop("batch_pos")
    merged = upsert.upsert_datasets(catalog[0], batch.unionByName(batch)).collect()
    assert len(merged) == len({r["id"] for r in merged}) == 5
    assert {r["id"]: r["title"] for r in merged}["new"] == "second"


def test_newest_first_ingest_moves_cursor_to_the_newest(spark):
    datasets, cursor = ingest_plan.ingest_listing(
        listing_of(spark), cursor_of(spark), NOW, limit=2, gap_safe=False
    )
    rows = {r["id"]: r for r in datasets.collect()}
    assert set(rows) == {"new", "b/3"} and rows["b/3"]["ns_local_id"] == "3" and rows["new"]["title"] == "new"
    assert json.loads(rows["new"]["quality_signals"]) == {"downloads": None, "likes": None, "gated": None}
    assert tuple(cursor.first()) == (datetime(2024, 1, 6), "new")
    _, kept = ingest_plan.ingest_listing(listing_of(spark), cursor_of(spark, (datetime(2025, 1, 1), "z")), NOW)
    assert tuple(kept.first()) == (datetime(2025, 1, 1), "z")


@pytest.mark.parametrize("n", [0, 1, 2, 7, 20, 21, 1000])
def test_p95_is_the_value_at_its_place(spark, make, n):
    rng = random.Random(n)
    spans = [rng.choice([0, 5, rng.randint(0, 2000), rng.randint(0, 10**10)]) for _ in range(n)]
    rows = [dict(id=str(i), state="done", started_at=NOW, finished_at=NOW + timedelta(microseconds=s)) for i, s in enumerate(spans)]
    rows += [dict(id="x", state="done", started_at=NOW), dict(id="y", state="error", started_at=NOW, finished_at=NOW + timedelta(days=9))]
    want = sorted(spans)[max(int(n * 0.95) - 1, 0)] / 1000 if n else 0.0
    assert metrics.resolve_p95(make("jobs", rows)).first()[0] == pytest.approx(want)


def test_rank_with_a_hot_value(spark):
    rows = [(-5,)] * 400 + [(v,) for v in range(-300, 300)]
    df = spark.createDataFrame(rows, "v long")
    ordered = sorted(v for v, in rows)
    for rank in (1, 2, 296, 500, 695, 696, 1000):
        assert metrics.value_at_rank(df, rank, -300, 299) == ordered[rank - 1]


def test_metrics_of_an_empty_catalog(make):
    row = metrics.admin_metrics(make("datasets", []), make("artifacts", []), make("jobs", []), NOW).first()
    assert (row["freshness_pct"], row["thin_readme_pct"], row["resolve_p95_ms"], row["queue_depth"]) == (0.0, 0.0, 0.0, 0)
    assert row["public_no_schema_count"] == 0 and row["error_taxonomy"] == {} and row["jobs_by_state"] == {}


def test_metrics_of_the_small_catalog(make, catalog):
    jobs = make("jobs", [dict(id="1", state="queued"), dict(id="2", state="done", error_class="timeout"), dict(id="3", state=None)])
    row = metrics.admin_metrics(*catalog, jobs, NOW).first()
    assert row["freshness_pct"] == 50.0 and row["thin_readme_pct"] == 50.0
    assert (row["public_no_schema_count"], row["public_with_schema_pct"]) == (1, 50.0)
    assert row["queue_depth"] == 1 and row["error_taxonomy"] == {"timeout": 1}
    assert row["jobs_by_state"] == {"queued": 1, "done": 1, "null": 1}


def test_state_and_facets(spark, make, catalog):
    jobs = make("jobs", [
        dict(id="1", dataset_id="plain", state="error", enqueued_at=NOW - timedelta(days=7)),
        dict(id="2", dataset_id="lab/bird-calls", state="error", enqueued_at=NOW - timedelta(days=6)),
    ])
    state = {r["id"]: (r["has_schema"], r["has_snips"], r["recent_errors"]) for r in metrics.dataset_state(*catalog, jobs, NOW).collect()}
    assert state == {"lab/river-levels": (1, 0, 0), "lab/bird-calls": (0, 0, 1), "lab/private-maps": (0, 0, 0), "plain": (0, 0, 0)}
    facets = {(r["facet"], r["value"]): r["n"] for r in metrics.facet_values(catalog[0]).collect()}
    assert facets["language", "en"] == 2 and facets["license", "mit"] == 1 and ("license", "") not in facets
    empty = metrics.facet_values(catalog[0].limit(0)).collect()
    assert len(empty) == 22 and all(r["n"] == 0 for r in empty)


def test_policy_order(spark):
    rows = [
        (None, None, None, None, 1, 1, "not_applicable"), (True, "private", "x", None, 9999, 1, "gated_private"),
        (True, "", "gpl", None, 1, 1, "license_denied"), (True, None, "", "n>100M", 1, 1, "size_exceeded"),
        (True, "public", "mit", "weird", 1501, 1, "time_budget_exceeded"), (True, "public", None, None, 1500, 201, "time_budget_exceeded"),
        (True, "public", "mit", "10M<n<100M", 1500, 200, None),
    ]
    df = spark.createDataFrame(rows, "known boolean, access_class string, license_class string, size_class string, budget_ms int, row_cap int, want string")
    for r in policy.policy_eval(df, replace(Settings(), max_size_class="10M<n<100M")).collect():
        assert (r["reason_code"], r["allow"]) == (r["want"], r["want"] is None)
    for ceiling in (None, "unknown"):
        open_ = policy.policy_eval(df, replace(Settings(), max_size_class=ceiling)).collect()
        assert open_[3]["allow"]


def test_requests_are_cached_blocked_or_queued(spark, catalog):
    datasets, artifacts = catalog
    asked = [("r1", "lab/river-levels", "schema", None, None), ("r2", "lab/river-levels", "snips", 0, None),
             ("r3", "gone", "stats", None, None), ("r4", "lab/bird-calls", "schema", None, None), ("r5", "lab/private-maps", "schema", None, None)]
    requests = spark.createDataFrame(asked, "request_id string, dataset_id string, kind string, budget_ms int, row_cap int")
    cached, blocked, jobs, events = resolve_plan.plan_resolves(requests, artifacts, datasets, NOW)
    # An artifact whose stale mark is unset is still served.
    assert {tuple(r) for r in cached.collect()} == {("r1", "cached-lab/river-levels"), ("r4", "cached-lab/bird-calls")}
    assert {(r["request_id"], r["reason_code"]) for r in blocked.collect()} == {("r3", "not_applicable"), ("r5", "gated_private")}
    assert [(r["id"], r["budget_ms"], r["row_cap"], r["state"]) for r in jobs.collect()] == [("r2", 1500, 200, "queued")]
    assert json.loads(events.first()["payload"]) == {"job_id": "r2", "kind": "snips", "budget_ms": 1500, "row_cap": 200}


def test_reclaim_edges(make):
    cut = NOW - timedelta(seconds=30)
    rows = [dict(id="just", state="running", started_at=cut - timedelta(microseconds=1), attempts=2),
            dict(id="edge", state="running", started_at=cut, attempts=0), dict(id="cap", state="running", started_at=datetime(2024, 1, 1), attempts=3),
            dict(id="none", state="running", attempts=0), dict(id="done", state="done", started_at=datetime(2024, 1, 1), attempts=0)]
    jobs = make("jobs", rows)
    got = {r["id"]: (r["state"], r["started_at"]) for r in job_ops.reclaim_stale(jobs, NOW, 30).collect()}
    assert got["just"] == ("queued", None) and [got[k][0] for k in ("edge", "cap", "none", "done")] == ["running"] * 3 + ["done"]
    assert job_ops.reclaim_stale(jobs, NOW, 0) is jobs


def test_start_jobs_takes_the_oldest(make):
    t = datetime(2024, 1, 1)
    rows = [dict(id=i, state="queued", enqueued_at=e) for i, e in (("b", t), ("a", t), ("c", t + timedelta(1)), ("z", None))]
    rows.append(dict(id="r", state="running", enqueued_at=datetime(2023, 1, 1)))
    jobs = make("jobs", rows)
    for n, want in ((1, {"a"}), (2, {"a", "b"}), (4, {"a", "b", "c", "z"}), (9, {"a", "b", "c", "z"})):
        got = {r["id"] for r in job_ops.start_jobs(jobs, n, NOW).collect() if r["started_at"] == NOW}
        assert got == want
    none = make("jobs", [dict(id="r", state="running")])
    assert job_ops.start_jobs(none, 3, NOW).first()["started_at"] is None


def test_prefetch(spark, make, catalog):
    datasets, artifacts = catalog
    thin = make("datasets", [dict(id=f"t{i}", access_class="public", readme_tokens=1, quality_signals=q) for i, q in
                             enumerate(['{"downloads":12.5}', '{"downloads":13.5}', "junk", '{"downloads":"99"}'])])
    signals = make("signals", [dict(id=str(i), dataset_id="t2", created_at=NOW - timedelta(days=7)) for i in range(2)]
                   + [dict(id="o", dataset_id="t3", created_at=NOW - timedelta(days=8))])
    ranked = prefetch.prefetch_candidates(datasets.unionByName(thin), artifacts, signals, NOW, 10)
    assert [r["id"] for r in ranked.collect()] == ["t2", "t3", "t1", "t0"]
    jobs = make("jobs", [dict(id="prefetch-t2", state="error", attempts=2)])
    row = metrics.admin_metrics(datasets, artifacts, jobs, NOW)
    got = {r["id"]: (r["state"], r["attempts"]) for r in prefetch.prefetch_jobs(ranked.limit(2), row, jobs, NOW).collect()}
    assert got == {"prefetch-t2": ("queued", 0), "prefetch-t3": ("queued", 0)}
    off = replace(Settings(), prefetch_enabled=False)
    kept = prefetch.prefetch_jobs(ranked, row, jobs, NOW, off).collect()
    assert [(r["id"], r["state"]) for r in kept] == [("prefetch-t2", "error")]


def test_pause_reasons(spark):
    df = spark.createDataFrame([(3001.0, 900, "resolve_slow"), (3000.0, 501, "queue_depth"), (1.0, 500, None)], "resolve_p95_ms double, queue_depth bigint, want string")
    for r in metrics.pause_reason(df).collect():
        assert (r["prefetch_reason"], r["prefetch_paused"]) == (r["want"], r["want"] is not None)
    off = metrics.pause_reason(df, replace(Settings(), prefetch_enabled=False)).collect()
    assert off[2]["prefetch_reason"] == "prefetch_disabled"


def test_artifact_lookup_and_display(spark, catalog):
    keys = spark.createDataFrame([("lab/river-levels", "schema"), ("lab/river-levels", "snips"), ("lab/bird-calls", "schema")], "dataset_id string, kind string")
    found = {(r["dataset_id"], r["kind"]) for r in filters.lookup_artifacts(catalog[1], keys).collect()}
    assert found == {("lab/river-levels", "schema"), ("lab/bird-calls", "schema")}
    shown = {r["id"]: tuple(r)[1:] for r in filters.display_description(catalog[0]).collect()}
    assert shown["plain"] == ("Plain river text", "No description", "")
    assert shown["lab/bird-calls"][1].startswith("Rufe") and shown["lab/private-maps"][0] == "lab/private-maps"


def test_joins_keep_one_row_per_dataset(catalog, make):
    datasets, artifacts = catalog
    assert joins.with_schema_flag(datasets, artifacts.unionByName(artifacts)).count() == 4
    signals = make("signals", [dict(id=str(i), dataset_id="plain", created_at=NOW) for i in range(3)])
    scores = {r["id"]: r["sig_score"] for r in joins.with_signal_score(datasets, signals, NOW).collect()}
    assert scores["plain"] == 3 and scores["lab/bird-calls"] == 0
