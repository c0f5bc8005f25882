"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores, ``BENCH_KEYS``
optionally the queries. Every query runs completely, into a sink that drops its rows; it
runs twice and the second, warm time counts. ``build_catalog`` is timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from shelfmark.plans import registry, tables
from shelfmark.session import local_session

HEADLINE = (
    "search_like search_bm25 search_batch search_with_fallback build_inverted_index "
    "like_match_join facet_values assign_docid admin_metrics resolve_p95_ms dataset_state "
    "prefetch_candidates policy_eval plan_resolves infer_schema resolve_schemas apply_outcomes "
    "ingest_listing upsert_datasets detect_changes mark_stale upsert_artifacts start_jobs "
    "readme_headings stream_popularity stream_signals"
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    keys = os.environ.get("BENCH_KEYS", HEADLINE).split()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "shelfmark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    begin = time.perf_counter()
    tables.index(spark, sf_dir)  # also derives the datasets and their search documents
    took = {"build_catalog": round(time.perf_counter() - begin, 3)}
    print(f"build_catalog {took['build_catalog']}", file=sys.stderr, flush=True)
    for key in keys:
        for _ in range(2):
            begin = time.perf_counter()
            queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[key] = round(time.perf_counter() - begin, 3)
        print(f"{key} {took[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "catalog_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
