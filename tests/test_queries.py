"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
import check_queries
from shelfmark.plans import oracles, registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.all_queries(), oracles.oracles()


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) == 109


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, con, key):
    assert check_queries.compare(spark, con, SF, QUERIES[key], ORACLES[key]) == ""


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
