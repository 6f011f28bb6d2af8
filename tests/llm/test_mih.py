import numpy as np
import pytest

from lexispark.llm import mih
from lexispark.llm.queries import ORACLES, QUERIES

from .oracle import same


def brute(rows, queries, k):
    out = []
    for q, c in queries:
        near = sorted(((c ^ x) & (2**64 - 1)).bit_count() * 10**9 + i for i, x in rows)[:k]
        out += [(q, r, n % 10**9, n // 10**9) for r, n in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,k,block", [(400, 10, 1 << 17), (400, 10, 50), (5, 10, 1 << 17), (3000, 3, 700)])
def test_against_brute_force(spark, n, k, block):
    rng = np.random.default_rng(n + k)
    codes = rng.integers(-(2**63), 2**63 - 1, n)
    codes[: n // 3] = codes[0]  # a common code
    codes[n // 3 : n // 2] = codes[0] ^ (1 << rng.integers(0, 62, n // 2 - n // 3))
    rows = [(int(i), int(c)) for i, c in enumerate(codes)] + [(1, int(codes[1]))]
    queries = [r for r in rows[:-1] if r[0] % 20 == 0]
    df = spark.createDataFrame([*rows, (None, 5), (7, None)], "id long, code long")
    got = mih.top_k(df, spark.createDataFrame([*queries, (None, 1), (99999, None)], "id long, code long"), k, block_rows=block, query_chunk=7)
    assert sorted(map(tuple, got.collect())) == brute(rows, queries, k)


def test_sql(spark):
    assert same(QUERIES["op1_mih"](spark, "/root/testdata/sf0.01"), ORACLES["op1_mih"], "/root/testdata/sf0.01") == 50


def test_codes_and_empty(spark):
    df = spark.createDataFrame([(1, [0.5, -1.0, 0.0, 2.0]), (2, None), (3, [1.0, None, 1.0, 1.0]), (4, [1.0])], "id long, v array<float>")
    assert [r.c for r in df.select(mih.sign_code("v", 4).alias("c")).collect()] == [0b1001, None, None, None]
    none = spark.createDataFrame([], "id long, code long")
    assert mih.top_k(none, none).count() == 0


def test_further_columns_with_clashing_names(spark):
    rows = [(i, i * i * 7919, "x", 3, -1) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, code long, query_id string, rank int, distance long")
    got = sorted(map(tuple, mih.top_k(df, df.filter("id < 3"), 4).collect()))
    assert got == brute([r[:2] for r in rows], [r[:2] for r in rows[:3]], 4)
    assert mih.top_k(df, df.filter("id < 3"), 4).columns == ["query_id", "rank", "id", "distance"]
