"""Every registered query against its SQL."""

import pytest

from lodestone.plans import catalog
from tests.oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, con, name):
    found = differences(catalog.queries()[name](spark, sf_dir), con, catalog.oracle_sql()[name])
    assert not found or (name in MAY_BE_EMPTY and found == "no row on either side")


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).collect()
