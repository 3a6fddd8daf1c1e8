"""Every registered query against its SQL; the flagship's schema; the contract's parts."""

import pytest

import __spark_entry__ as entry
from cutline.plans import catalogue

from .oracle import assert_same, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, small, con, name):
    assert_same(catalogue.QUERIES[name](spark, small), con, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_contract(spark):
    assert entry.entry(spark).columns[0] == "l_partkey"
    assert set(entry.oracle_sql()) <= set(entry.queries())
