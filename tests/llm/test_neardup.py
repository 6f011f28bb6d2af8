import itertools
import random

import pytest

import corpus_pipeline as cp
from lexispark.llm import neardup

SF = "/root/testdata/sf0.01"


def brute_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def brute_kept(rows):
    """Ids that stay of rows (id, text): pairs of five-word similarity 0.8 or more link."""
    rows = sorted(rows)
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def edited(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), max(1, round(share * len(out)))):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("block", [1000, 7])
def test_pairs_of_all_similarities_against_brute_force(spark, block):
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(80, 300))]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.uniform(0.0, 0.06)))]
    hot = [f"h{rng.randrange(4000)}" for _ in range(200)]
    texts += [" ".join(edited(rng, hot, 0.015)) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), block_texts=block).collect()}
    assert got == brute_kept(rows)


@pytest.mark.parametrize("hot,parts", [(5, 5), (40, 2)])
def test_hot_keys_and_probes_against_brute_force(spark, monkeypatch, hot, parts):
    """Keys far above the limit are cut into cells, and an index with probes finds the same groups."""
    monkeypatch.setattr(neardup, "MOST_PARTS", parts)
    rng = random.Random(4)
    hub = [f"h{rng.randrange(4000)}" for _ in range(150)]
    texts = [" ".join(edited(rng, hub, 0.02)) for _ in range(90)] + [" ".join(f"w{rng.randrange(4000)}" for _ in range(90)) for _ in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text")
    numbered = df.mapInArrow(neardup._numbered, neardup._NUMBERED).persist()
    few = {(r.node, r.root) for r in neardup.coarse_groups(numbered, hot_rows=hot).collect()}
    assert few == {(r.node, r.root) for r in neardup.coarse_groups(numbered).collect()}
    got = {r.doc_id for r in neardup.keep_one(df).collect()}
    assert got == brute_kept(rows)


def test_the_stage_finds_what_three_bits_miss(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = cp.near_dedup(spark, docs, SF).collect()
    assert {r.doc_id for r in got} == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(spark):
    schema = "doc_id long, text string, node string"
    assert neardup.keep_one(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d", "x"), (2, "A b  c d", "y"), (3, None, "z"), (4, " ", "z"), (None, "", "z"), (None, "of its own", "k"), (None, "Of its own", "k"), (5, "more words", "a"), (5, "more words", "a"), (5, "other", "a")]
    got = sorted(((r.doc_id or 0, (r.text or "").lower(), r.node) for r in neardup.keep_one(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, "of its own", "k"), (1, "a b c d", "x"), (3, "", "z"), (5, "more words", "a")]
