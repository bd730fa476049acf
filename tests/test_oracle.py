"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect
from voicegrid.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, verdict = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["month", "company", "product"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
