"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert ok, message


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["verdict"] for r in rows} <= {"live", "spoof", "low_quality"} and rows
