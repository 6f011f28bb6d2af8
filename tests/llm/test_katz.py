import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import katz


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Brute:
    """The documented model, straight from its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.count = [collections.Counter() for _ in range(order + 1)]
        for t in texts:
            w = ["<begin>", *tokens(t)]
            for m in range(1, order + 1):
                for i in range(1, len(w)):
                    if i - m + 1 >= (0 if m > 1 else 1):
                        self.count[m][tuple(w[i - m + 1 : i + 1])] += 1
        self.d = [None]
        for m in range(1, order + 1):
            n = [sum(c == r for c in self.count[m].values()) for r in range(1, 7)]
            self.d.append(katz.discounts(np.array(n)))
        self.after = collections.defaultdict(list)
        for m in range(1, order + 1):
            for g, c in self.count[m].items():
                self.after[g[:-1]].append((g[-1], c))

    def freed(self, history):
        d = self.d[len(history) + 1]
        mass = sum((1 - d[c]) * c for _, c in self.after[history] if c <= 5)
        total = sum(c for _, c in self.after[history])
        return (mass, total) if mass > 0 else (1.0, total + 1)

    def p(self, word, history):
        m = len(history) + 1
        c = self.count[m][(*history, word)]
        if m > 1 and history not in self.after:
            return self.p(word, history[1:])
        mass, total = self.freed(history)
        if c:
            return (self.d[m][c] if c <= 5 else 1.0) * c / total
        if m == 1:
            return mass / total
        return mass / total / (1 - sum(self.p(w, history[1:]) for w, _ in self.after[history])) * self.p(word, history[1:])

    def score(self, text):
        w = ["<begin>", *tokens(text)]
        out = 0.0
        for i in range(1, len(w)):
            lo = max(0, i - self.order + 1)
            out += math.log10(self.p(w[i], tuple(w[lo:i])))
        return out


def corpus(n=150):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(vocabulary, weights, k=rng.randint(0, 60)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "never seen words"), (n + 20, "w1é " * 3000), rows[3], (None, "w1é w2é")]


@pytest.mark.parametrize("order,hot", [(2, False), (3, False), (2, True), (3, True)])
def test_against_brute_force(spark, order, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(katz, "HOT_TOKENS", 50)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got, model = katz.fit_and_score(df, ~katz.held_out(), order=order, block_bytes=2000)
    got = sorted(map(tuple, got.collect()), key=str)
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10]
    brute = Brute(train, order)
    n = sum(brute.count[1].values())
    v = len(brute.count[1])
    want = []
    for i, t in rows:
        w = tokens(t)
        c = [brute.count[1][(x,)] for x in w]
        held = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        want.append((i, held, len(w), sum(x > 0 for x in c), n, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), brute.score(t)))
    want.sort(key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: str(r[:4])), sorted(want, key=lambda r: str(r[:4]))):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert model.filter(f"level = {order}").count() > 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_normalised(order):
    brute = Brute([t for _, t in corpus(40)], order)
    known = [w for (w,) in brute.count[1]]
    for history in list(brute.after)[:60]:
        assert sum(brute.p(w, history) for w in [*known, "unheard"]) == pytest.approx(1, abs=1e-9)


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.fit_and_score(empty, ~katz.held_out())[0].count() == 0
    none = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = katz.fit_and_score(none, F.lit(False))[0].orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_further_columns_with_clashing_names(spark):
    rows = [(i, f"a b c w{i % 3}") for i in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    odd = plain.selectExpr("*", "'x' as train", "1 as held_out", "'y' as n_tokens", "2 as chunk", "'z' as level", "3 as bucket", "null as base_score")
    both = [sorted(map(tuple, katz.fit_and_score(df, ~katz.held_out())[0].collect())) for df in (plain, odd)]
    assert both[0] == both[1] and len(both[0]) == 30
