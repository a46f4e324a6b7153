"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from brackish.plans import all_queries
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_twins_name_queries():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(all_queries()[0]))
def test_query(spark, duck, name):
    """The training-data queries have tests of their own."""
    assert compare(spark, duck, FOLDER, name, queries()[name], oracle_sql().get(name)) == ""
