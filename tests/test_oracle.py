"""Every query with an oracle: Spark result == DuckDB result on the smallest tables
(sorted column names, order-insensitive rows, floats to 6 places) -- the driver's check."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck_connect  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF)


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF)
    assert res["status"] == "ok", res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "flight_id" in df.columns
