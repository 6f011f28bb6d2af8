"""Runs a query's DuckDB SQL over a directory of tables or over given frames and compares it with Spark's rows."""

import os

import duckdb


def duck_rows(sql, sf_dir=None, tables=None):
    con = duckdb.connect()
    for name in os.listdir(sf_dir) if sf_dir else ():
        path = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    for name, frame in (tables or {}).items():
        con.register(name, frame)
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(df, sql, sf_dir=None, tables=None, digits=6):
    names, want = duck_rows(sql, sf_dir, tables)
    assert sorted(names) == sorted(df.columns)
    norm = lambda v: round(v, digits) if isinstance(v, float) else v
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted((tuple(norm(r[n]) for n in sorted(names)) for r in df.collect()), key=key)
    want = sorted((tuple(norm(dict(zip(names, r))[n]) for n in sorted(names)) for r in want), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == b, (a, b)
    return len(got)
