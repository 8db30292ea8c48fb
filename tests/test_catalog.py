import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_contract(spark):
    assert set(SQL) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert differences(spark, con, entry.queries()[name], SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_query_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0
