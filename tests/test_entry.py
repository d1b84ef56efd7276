"""The driver's entry points."""

import os

import pytest

import __spark_entry__ as entry


def test_sql_is_of_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
