"""Every query of the catalogue against DuckDB on the same tables."""

import datetime
import decimal

import duckdb
import pytest

from basalt.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return connection


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return str(x) if isinstance(x, (datetime.date, decimal.Decimal)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(repr(tuple(plain(row[c]) for c in names)) for row in got.collect())
    b = sorted(repr(tuple(map(plain, row))) for row in want.fetchall())
    assert a == b
