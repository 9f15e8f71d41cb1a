"""Every registered query that has SQL against it on the smallest tables; the text queries without are tested in tests/llm."""

import os

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_DIR)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    assert name in queries()
    agrees, note = check.compare(spark, con, name, SF_DIR)
    assert agrees, note


def test_entry(spark):
    assert entry(spark).count() > 0
