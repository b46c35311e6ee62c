"""Every query with SQL against DuckDB, on the smallest data set (set CHECK_SF_DIR for others)."""

import os

import pytest

import __spark_entry__ as entry
from gaugeframe.plans.registry import CHECKS, QUERIES
from tests.check_queries import database, difference

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, CHECKS[name]) is None


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(CHECKS) == set(QUERIES)  # every query of the library itself has SQL


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["WHO_region", "Date_reported", "Cumulative_deaths", "Cumulative_cases", "Fatality_rate"]
    assert df.count() > 0
