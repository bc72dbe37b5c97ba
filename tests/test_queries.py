"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from lexmill import plans as registered
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    problems, _, _, _ = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert not problems, problems


def test_entry_offers_every_query():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
