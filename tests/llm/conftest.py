import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_texts import ODD_TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null id, a repeated row, and columns that clash with results."""
    rows = [(i, t, "x", 1.5, i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "no id here", "y", 0.0, -1), rows[10]]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, score double, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def tables(spark):
    def read(name, sf="0.01"):
        return spark.read.parquet(f"/root/testdata/sf{sf}/{name}.parquet")

    return read
