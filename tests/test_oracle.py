"""Every registered query against its SQL, on the smallest of the given table sets."""

import pytest

import __spark_entry__ as contract
from checks.oracle import ORACLE
from checks.queries import REGISTERED
from tools.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(REGISTERED) == set(ORACLE)
    assert set(REGISTERED) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert [r["period"] for r in contract.entry(spark).collect()] == ["Baseline"] * 3 + ["Current"] * 2 + ["Future"] * 2


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query(spark, con, name):
    _, problems = differences(spark, con, SF_DIR, name)
    assert not problems
