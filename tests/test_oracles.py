"""Every registered query against its SQL oracle on the smallest tables."""

import pytest

import __spark_entry__ as registered
from check import compare, duck
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries()) and set(ORACLES) <= set(registered.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_oracle(spark, con, name):
    assert compare(spark, con, SF, name) == ""
