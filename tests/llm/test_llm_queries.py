"""The queries of the llm package against their SQL, or for their mere rows."""

import pytest

from driftloom.llm import queries as llm
from oracle import SF, connect, same

QUERIES, SQL = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["pair_id", "defect"]), ("p3_found", ["target_field", "category"]), ("p4_found", ["msg_id", "pii_kind"]), ("p5_found", ["dialogue_id", "defect"]), ("p6_found", ["limit_name", "doc_id"]), ("p7_found", ["source"]), ("p8_found", ["doc_id"])])
def test_columns(spark, name, columns):
    df = QUERIES[name](spark, SF)
    assert df.columns == columns and df.count() == df.distinct().count()
