"""Every registered query against its SQL on the small tables."""

import pytest
from oracle import compare, connect

from rillflow.catalog import catalog

CATALOG = catalog()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf_dir, con, name):
    fn, sql = CATALOG[name]
    df = fn(spark, sf_dir)
    assert sql, "a query without SQL needs a fixture test"
    assert compare(df, con, sql) is None
