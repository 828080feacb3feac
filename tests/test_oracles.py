import pytest

import __spark_entry__ as entry
from tests.compare import connect, same_rows
from weftline.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    same_rows(catalog.QUERIES[name](spark, sf), con, catalog.ORACLES[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_all_queries_are_callables():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
