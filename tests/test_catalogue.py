import pytest

from spanloom.plans import (
    catalogue,
    dictionaries,  # noqa: F401  registers its queries with the catalogue's
    exchange,  # noqa: F401
    job_queries,  # noqa: F401
    joint,  # noqa: F401
    reporting,  # noqa: F401
    similar,  # noqa: F401
)

from .oracle import compare, connect


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, connection, name):
    compare(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], connection)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).collect()
