"""Registered queries against their SQL on the smallest data (the gate runs all of them)."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    assert difference(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) is None


def test_every_query_has_its_check():
    assert set(entry.QUERIES) == set(entry.SQL)
    assert set(entry.CORPUS_SQL) <= set(entry.CORPUS)
