"""Every registered query against its SQL on the smallest tables."""
from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from demo.check import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    problem, rows, _ = differences(spark, con, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert not problem, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
