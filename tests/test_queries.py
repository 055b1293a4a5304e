"""Every registered query against its SQL restatement on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

DIRECTORY = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    note = compare(spark, con, DIRECTORY, name, QUERIES[name], SQL.get(name))
    assert note in ("", "no rows on either side"), note


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_restatements_belong_to_queries():
    assert set(SQL) <= set(QUERIES)
