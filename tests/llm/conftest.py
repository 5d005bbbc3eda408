import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import helpers  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows, items and the stored table of documents."""
    rows, items = helpers.make_docs()
    docs = spark.createDataFrame(rows, helpers.SCHEMA).repartition(5)
    return rows, items, docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], helpers.SCHEMA)
