"""Every registered query against its SQL in DuckDB."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry
from dqengine.checks import registry as checks

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_entry_and_names(spark):
    issues = entry.entry(spark)
    assert issues.count() == 5
    assert set(ORACLES) <= set(QUERIES)
    assert {name for name in checks.QUERIES if name not in checks.ORACLES} == set()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0
