"""Every registered query against its SQL on the smallest driver tables."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        ok, message = compare(df, con, ORACLES[name])
        assert ok, message
    else:
        df.collect()


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
