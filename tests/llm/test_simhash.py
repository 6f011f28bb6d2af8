import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from lexispark.llm import simhash


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcéßZ") for _ in range(rng.randint(1, 9)))
    base = [[word() for _ in range(rng.randint(1, 400))] for _ in range(40)]
    texts = [" ".join(w) for w in base] + ["\t\n ".join(w) for w in base[:10]]
    for w in base[:20]:
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    return texts + [None, "", " \n", "x" * 300_000 + " y", "A b", "a B"]


def test_against_brute_force(spark):
    rows = [(i * 3 % 1000, t, "clash") for i, t in enumerate(corpus())]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    fps = [brute_fp(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in set(roots)}
    want = sorted((rows[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(rows)))
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("hot", [8192, 6])
def test_links_of_close_fingerprints(spark, hot):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for f in list(fps)[:40]:
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = [int(x) for x in np.array(fps, dtype=np.uint64).view(np.int64)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df, hot_rows=hot).collect()
    for a, b in edges:
        assert a != b
    from lexispark.llm.common import components

    comp = dict(components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect())
    roots = brute_components(fps)
    assert len({comp.get(s, s) for s in signed}) == len(set(roots))
    for i, j in itertools.combinations(range(len(fps)), 2):
        assert (roots[i] == roots[j]) == (comp.get(signed[i], signed[i]) == comp.get(signed[j], signed[j]))


@pytest.mark.parametrize("total", [10**3, 10**6, 10**9])
def test_thresholds_cover(total):
    sample = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    index = simhash.fit(sample, total)
    assert sorted(b for p in index.parts for b in p) == list(range(64))
    assert sum(index.thresholds) == 3 - len(index.parts) + 1


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (None, ""), (3, "")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id is None, r.component_id) for r in got if r.component_id) == [(False, False, 3), (True, False, 3)]
    assert sum(r.component_id is None for r in got) == 1


def test_keep_one(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b  c d", "y"), (3, "other words here now", "z"), (3, "other words here now", "z")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, simhash.keep_one(df).select("doc_id", "lang").collect())) == [(1, "x"), (3, "z")]
