"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
from query_catalog.oracles import ORACLES
from query_catalog.queries import REGISTERED
from check_oracles import compare, oracle_connection

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = oracle_connection(FOLDER)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(REGISTERED) == set(ORACLES)
    assert set(REGISTERED) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(REGISTERED))
def test_query_equals_sql(spark, con, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    assert compare(frame, con, entry_points.oracle_sql()[name]) is None


def test_entry(spark):
    rows = entry_points.entry(spark)
    assert rows.columns == ["part", "pos", "value"] and rows.count() == 5 + 64 + 1
