"""Every registered query with SQL against DuckDB on the same tables; the others by their rows."""

import os

import duckdb
import pytest

import lexispark.queries  # noqa: F401
from lexispark.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def normal(v):
    return round(v, 5) if isinstance(v, float) else round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda r: [(v is None, str(v)) for v in r]
    want = sorted((tuple(normal(dict(zip(names, r))[n]) for n in order) for r in cur.fetchall()), key=key)
    got = sorted((tuple(normal(r[n]) for n in order) for r in df.collect()), key=key)
    assert len(got) == len(want) and got
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
