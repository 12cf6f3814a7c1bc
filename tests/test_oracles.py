"""Every query that SQL can express gives what DuckDB gives, on the smallest tables."""

import os

import pytest

from mediasift.plans import catalog
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(spark, con, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
