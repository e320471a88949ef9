"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

from panelforge.catalog import QUERIES, SQL
from tests.oracle import compare, open_tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_rows(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert rows
    # a model result without SQL must at least be finite
    for row in rows[:50]:
        assert all(v is None or v == v for v in row)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
