"""Every named query that has SQL must give the rows of its SQL on the smallest tables."""

import pytest
from check_queries import compare, duck

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, name):
    good, note = compare(entry.queries()[name](spark, SF_DIR), connection, entry.oracle_sql()[name])
    assert good, note
