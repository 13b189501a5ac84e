"""Every query of the catalogue against DuckDB on the smallest tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

from tessera import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in catalogue.TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)


def test_every_query_has_an_oracle():
    assert set(catalogue.queries()) == set(catalogue.oracles())


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_same_as_duckdb(spark, duck, name):
    frame = catalogue.queries()[name](spark, FOLDER)
    relation = duck.sql(catalogue.oracles()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = sorted(tuple(plain(dict(zip(relation.columns, r, strict=True))[c]) for c in columns) for r in relation.fetchall())
    assert ours == theirs
