"""What plans must and must not contain."""

import re

import pytest

from shelfmark.operators import filters, joins, ordering
from shelfmark.operators import search as search_ops
from shelfmark.plans import registry, tables

SF = "/root/testdata/sf0.001"
QUERIES = registry.all_queries()
STREAMS = {k for k in QUERIES if k.startswith("stream_")}
BOUNDED_WINDOW = {"assign_docid"}  # numbers at most 4,096 bucket sizes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(set(QUERIES) - STREAMS))
def test_no_nested_loops_python_or_single_task_windows(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert word not in plan
    single = re.findall(r"windowspecdefinition\([\w#]+ (?:ASC|DESC)", plan)
    assert (key in BOUNDED_WINDOW) == bool(single)


def test_anti_join(spark):
    plan = plan_of(joins.without_schema(tables.datasets(spark, SF), tables.artifacts(spark, SF)))
    assert "LeftAnti" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(filters.by_license(tables.datasets(spark, SF), "mit").select("id"))
    assert "EqualTo(license_class,mit)" in plan and "ReadSchema: struct<id:string,license_class:string>" in plan


def test_examples_are_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["infer_schema"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_batch_ranking_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["rank_hits_batch"](spark, SF))
    assert plan.count("WindowGroupLimit") >= 2


def test_postings_join_reads_only_folders_of_its_terms(spark):
    terms = spark.createDataFrame([("the",), ("der",)], "term string")
    plan = plan_of(search_ops.postings_join(tables.index(spark, SF), terms))
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert " IN (" in plan.split("PartitionFilters: ")[1][:80] or "IN (" in plan


def test_page_is_a_top_k(spark):
    hits = spark.range(10).selectExpr("cast(id as string) id", "id score")
    assert "TakeOrderedAndProject" in plan_of(ordering.rank_hits(hits, 3, 2))
