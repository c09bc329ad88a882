"""Every registered query against its SQL check on the smallest test data."""

import pytest

import __spark_entry__ as contract
from ledgerlens.registry import CHECKS, QUERIES, check_sql
from tests.compare import connect, difference

CHECKS = {name: check_sql(name) for name in CHECKS}


@pytest.fixture(scope="module")
def database(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_agrees_with_sql(name, spark, sf_dir, database):
    assert difference(QUERIES[name](spark, sf_dir), database, CHECKS[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_query_without_sql_returns_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
