import pytest

from spanloom.llm import queries

from ..oracle import compare, connect


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, sf, connection, name):
    assert compare(queries.queries()[name](spark, sf), queries.ORACLES[name], connection)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 13))
