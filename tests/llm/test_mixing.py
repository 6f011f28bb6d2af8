import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import mixing
from lexispark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """Shares by weight, the excess over three times a size shared again until there is none."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, docs):
    assert len(rows) == len(docs)
    want = collections.Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in docs)
    assert collections.Counter((r.doc_id, r.size, r.source) for r in rows) == want
    sizes = collections.defaultdict(int)
    taken = collections.defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    targets = brute_targets(dict(sizes))
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-9, abs=1e-9)
    # a source's number of slots is binomial: four deviations, and some blocks that are not full
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 4 * (targets[s] * mixing.BLOCK) ** 0.5 + 3 * mixing.BLOCK, (s, taken[s], targets[s])


def test_whole_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = QUERIES["op6_mixing"](spark, SF).collect()
    check(rows, docs)
    assert collections.Counter(rows) == collections.Counter(QUERIES["op6_mixing"](spark, SF).collect())


def test_edges(spark):
    rng = random.Random(1)
    docs = [(i, " \n".join("w" for _ in range(rng.randint(0, 900))), rng.choice(["a", "b", "é", None, "z"])) for i in range(200)]
    docs += [(300, "tiny doc", "small"), (301, None, "void"), (302, "", None), (None, "x y", "a"), docs[0], docs[0], (400, "w " * 60_000, "b")]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, source string, size long")
    check(mixing.mix(df).collect(), docs)
    assert mixing.mix(df.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(df.filter("doc_id = 301")).collect()] == [0]


def test_counts_follow_slots(spark, monkeypatch):
    """taken, from the stored stream positions and the slots, one word at a time."""
    df = spark.createDataFrame([(i, "w " * (37 * i % 211), f"s{i % 4}") for i in range(60)], "doc_id long, text string, source string")
    rows = mixing._documents(df, "doc_id", "text", "source", mixing.SEED).persist()
    plan = mixing._plan(rows, 16, 32, 3, (1, 2, 3)).persist()
    slots = mixing.slots(plan, mixing.SEED).collect()
    number = {r.src: r for r in plan.collect()}
    for src, p in number.items():
        own = sorted((x.n, x.block) for x in slots if x.s == p.s)
        assert [n for n, _ in own] == list(range(len(own)))
        for turn in range(3):
            some = [b for n, b in own if n // p.blocks == turn]
            assert len(some) == len(set(some)) and all(0 <= b < p.blocks for b in some)
        assert abs(len(own) - min(p.slots, 3 * p.blocks)) <= 4 + 4 * p.slots**0.5
    times = collections.Counter((x.s, x.block) for x in slots)
    got = {r.doc_id: r.taken for r in mixing.mix(df, block=16, shard=32).collect()}
    for r in rows.collect():
        s = number[r.src].s
        assert got[r.doc_id] == sum(times[s, w // 16] for w in range(r["at"], r["at"] + r["size"]))


def test_counts_of_a_shard_are_multinomial(spark, monkeypatch):
    """Means, variances and covariances over many shards, and the number of slots of each; merged bins give the same draw."""
    sizes = [("a", 40_000), ("b", 90_000), ("c", 150_000), ("d", 400_000)]
    docs = spark.createDataFrame([(s, True, n) for s, n in sizes], "src string, known boolean, size long")
    plan = mixing._plan(docs, 8, 32, 3, (1, 2, 3)).persist()
    rows = mixing.draws(plan).collect()
    share = {r.s: r.slots / sum(x.slots for x in plan.collect()) for r in plan.collect()}
    shards, total = plan.first().shards, plan.first().all_slots
    count = np.zeros((shards, len(sizes)))
    for r in rows:
        count[r.shard, r.s] = r.number
    assert (count.sum(axis=1)[:-1] == 32).all() and count.sum() == total
    full = count[:-1]
    p = np.array([share[k] for k in range(len(sizes))])
    want = 32 * (np.diag(p) - np.outer(p, p))
    n = len(full)
    assert n > 2000
    assert np.abs(full.mean(axis=0) - 32 * p).max() < 5 * (32 * p.max() / n) ** 0.5
    assert np.abs(np.cov(full.T) - want).max() < 0.06 * want.max()
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert collections.Counter(mixing.draws(plan).collect()) == collections.Counter(rows)


def test_mixed_blocks_are_what_is_taken(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" for _ in range(rng.randint(0, 200))), rng.choice(["a", "b", None])) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix(df, block=16, shard=32).collect()}
    pieces = mixing.blocks(df, block=16, shard=32).collect()
    total, slot = collections.Counter(), collections.Counter()
    size = {i: len(t.split()) for i, t, _ in docs}
    for r in pieces:
        total[r.doc_id] += r.words
        slot[r.source, r.n, r.shard] += r.words
        assert 0 <= r["first"] and r["first"] + r.words <= size[r.doc_id] and r.words > 0
    assert {i: total[i] for i in taken} == taken
    assert max(slot.values()) == 16 and len(slot) == len({(s, n) for s, n, _ in slot})
    per_shard = collections.Counter(k for _, _, k in slot)
    assert max(per_shard.values()) <= 32


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 1_000_003])
def test_permutation(spark, size):
    df = spark.range(size).select("id", F.lit(size).cast("long").alias("size"), F.lit(3).alias("s"), F.lit(1).alias("turn"))
    got = mixing.permuted(df, "id", "size", "s", "turn", "x", 5).agg(F.min("x"), F.max("x"), F.count_distinct("x")).first()
    assert tuple(got) == (0, size - 1, size)
