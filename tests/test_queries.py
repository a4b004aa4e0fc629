"""Every registered query of the engine against its oracle at the smallest scale."""

import pytest

import __spark_entry__ as entry
from cuespark.plans.catalog import ORACLES, QUERIES
from tests.oracle import assert_same, duck


@pytest.fixture(scope="module")
def connection(data):
    return duck(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, connection, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        assert_same(df, connection, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == ["phrase", "count"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
