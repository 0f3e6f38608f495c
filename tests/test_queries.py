"""Every query runs on small tables; those with SQL give the same rows."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, rows

CORE = {k: f for m in entry._MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in entry._MODULES for k, s in m.ORACLE.items()}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, data, duck, name):
    got = CORE[name](spark, data).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
