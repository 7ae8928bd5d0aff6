"""Every registered query against its DuckDB oracle (the driver's gate), on sf0.001."""

import os

import pytest

import __spark_entry__ as E
from marketspark.plans.registry import QUERIES
from tests.oracle_compare import compare, duck

SF = os.environ.get("MARKETSPARK_TEST_SF", "/root/testdata/sf0.001")
SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    build = E.queries()[name]
    if name not in SQLS:
        assert build(spark, SF).count() >= 0
        return
    n, problems = compare(spark, con, name, build, SQLS[name], SF)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "avg_sentiment" in df.columns
