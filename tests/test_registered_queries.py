"""Every registered query against its SQL twin on the smallest data set."""

import os

import pytest

pytest.importorskip("duckdb")

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQLS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in SQLS:
        assert compare(df, con, SQLS[name]) is None
    else:
        assert not df.isEmpty()


def test_flagship(spark):
    assert {r.split for r in entry.entry(spark).collect()} == {"train", "test"}
