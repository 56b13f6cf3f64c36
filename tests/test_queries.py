"""Every query of the engine against its SQL, or for its mere rows."""

import pytest

from driftloom.plans import registry
from oracle import SF, connect, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
