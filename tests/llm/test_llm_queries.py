"""The queries of the subpackage: those with SQL against it, all on the small data."""

import pytest

from tausift.llm import queries
from tests.oracle import DATA, connect, rows

COLUMNS = {
    "p1_found": [("query_id", "string"), ("field_name", "string"), ("defect", "string")],
    "p2_found": [("language_iso", "string"), ("place", "int"), ("model_id", "string")],
    "p3_found": [("doc_id", "string"), ("cut_kind", "string")],
    "p5_found": [("source_a", "string"), ("key_a", "string"), ("source_b", "string"), ("key_b", "string")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    got = df.toPandas()
    assert len(got)
    if name.endswith("_found"):
        assert not got.duplicated().any()
    if name in queries.ORACLE:
        assert rows(got) == rows(con.execute(queries.ORACLE[name]).df())


def test_containers_hold(spark):
    got = queries.p6_containers(spark, DATA).groupBy("container_id").sum("n_tokens").toPandas()
    assert got["sum(n_tokens)"].max() <= 2048
