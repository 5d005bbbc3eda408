"""Every named query against its SQL twin, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from tools.check_oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, name, SF)
    assert ok, note


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
