"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from coordlytics.plans.registry import all_entries
from oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_entries()))
def test_query_matches_sql(spark, con, name):
    df = contract.queries()[name](spark, FOLDER)
    assert difference(df, con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
