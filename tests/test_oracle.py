"""Every registered query against its SQL check, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CHECKS = entry.oracle_sql()
QUERIES = entry.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


def test_every_query_of_the_engine_has_a_check():
    assert set(entry.catalog.QUERIES) == set(entry.catalog.CHECKS)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_matches_its_check(spark, connection, name):
    same, text = compare(spark, connection, QUERIES[name], CHECKS[name], SF_DIR)
    assert same, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5
