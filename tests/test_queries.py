"""Every query with SQL against that SQL; the others must run and keep their columns."""

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, connect, rows

CORE = {n: q for n, q in entry.queries().items() if "llm" not in q.__module__}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    got = CORE[name](spark, DATA).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
