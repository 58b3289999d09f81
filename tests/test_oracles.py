"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from suite.catalog import ORACLES, QUERIES

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return repr(value) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, duck, name):
    result = QUERIES[name](spark, DATA)
    columns = sorted(result.columns)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = sorted(tuple(plain(row[i]) for i in places) for row in cursor.fetchall())
    assert sorted(tuple(plain(row[c]) for c in columns) for row in result.collect()) == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
