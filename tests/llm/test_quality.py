import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import learn, quality
from lexispark.llm import textkernel as tk
from lexispark.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op3_quality"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (2, "", 9), (None, "a b", 9), (3, "good words " * 50_000, 9)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (3, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, F.lit(False))
    got = quality.annotate(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    nothing = quality.annotate(docs, quality.fit(docs, labels.limit(0), F.lit(False)))
    assert {r.score for r in nothing.collect()} == {0.5}
    assert quality.annotate(docs.limit(0), model).count() == 0


def brute_features(text):
    """The statistics of one text, a character or word at a time."""
    raw = (text or "").encode()
    space, marks = b" \t\n\x0b\x0c\r", b".,;:?!'\"()-"
    kind = lambda b: 0 if b in space else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in marks else 1 if 97 <= b <= 122 or b >= 128 else 5
    words = re.findall(rb"[^ \t\n\x0b\x0c\r]+", raw)
    low = [w.lower() for w in words]  # bytes.lower folds ASCII only
    lines = [x.lower() for x in re.split(rb"[\n\r]", raw) if x]
    size, n, m = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    share = lambda k: sum(kind(b) == k for b in raw) / size
    pairs = list(zip(low, low[1:]))
    again = lambda x: len(x) - len(set(x))
    ended = lambda k: sum(kind(w[-1]) == k for w in words) / n
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sum(map(len, words)) / n, share(2), share(3), share(4), share(5), share(0), len(lines) / n, again(lines) / m,
        sum(a == b for a, b in zip(low, low[1:])) / n, sum(a == b for a, b in zip(low, low[2:])) / n, again(low) / n, again(pairs) / n, max(map(low.count, low), default=0) / n,
        ended(5), ended(4), sum(not any(kind(b) in (1, 2) for b in w) for w in words) / n, sum(len(w) > 30 for w in words) / n, sum(b >= 128 for b in raw) / size,
    ]


def test_features_against_brute_force():
    rng = random.Random(6)
    pool = ["the", "The", "é", "x" * 40, "12", "##", "end.", "(a", "line\nbreak", "\r\n", "w", "W", "mix1", "…"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", " \n", "same\nsame\nsame"]
    x = quality.features(*tk.buffers(pa.array(texts)), tk.SpanHash())
    for k, t in enumerate(texts):
        assert x[k] == pytest.approx(brute_features(t)), t


@pytest.mark.parametrize("prior,shift", [(0.2, 0.0), (0.9, -3.0)])
def test_steps_follow_the_slope_of_the_risk(prior, shift):
    """By differences: down the risk, and against its second part where that is negative."""
    rng = np.random.default_rng(3)
    loss = lambda z: np.logaddexp(0, -z)
    gp, gu = rng.normal(-shift, 2, 50), rng.normal(-1 + shift, 2, 50)
    first = lambda gp: prior * loss(gp).mean()
    second = lambda gp, gu: loss(-gu).mean() - prior * loss(-gp).mean()
    down = second(gp, gu) >= 0
    assert down == (shift == 0)
    risk = (lambda gp, gu: first(gp) + second(gp, gu)) if down else (lambda gp, gu: -second(gp, gu))
    sp, su = learn.pu_slopes(gp, gu, prior)
    for k in (0, 7, 31):
        e = np.zeros(50)
        e[k] = 1e-6
        assert sp[k] / 50 == pytest.approx((risk(gp + e, gu) - risk(gp - e, gu)) / 2e-6, abs=1e-6)
        assert su[k] / 50 == pytest.approx((risk(gp, gu + e) - risk(gp, gu - e)) / 2e-6, abs=1e-6)


def test_features_cover_whole_text():
    hasher = tk.SpanHash()
    base = "some words of a text. " * 2000
    x = quality.features(*tk.buffers(pa.array([base, base + "!!## " * 2000, None, "same\nsame\nsame"])), hasher)
    i = quality.NAMES.index
    assert x[1, i("other")] > x[0, i("other")]
    assert x[3, i("line_repeats")] == pytest.approx(2 / 3) and x[3, i("next_same")] == pytest.approx(2 / 3)
    assert np.isfinite(x).all()


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.9])
def test_prior_and_risk_on_known_mixture(prior):
    rng = np.random.default_rng(1)
    draw = lambda n, mean: rng.normal(mean, 1, (n, 2))
    p = draw(3000, 2)
    u = np.concatenate([draw(int(4000 * prior), 2), draw(int(4000 * (1 - prior)), -2)])
    scores = (p.sum(axis=1), u.sum(axis=1))
    assert learn.estimate_prior(*scores) == pytest.approx(prior, abs=0.05)
    net = learn.fit_nnpu(p, u, prior)
    assert (net(draw(2000, 2)) >= 0.5).mean() > 0.93 and (net(draw(2000, -2)) < 0.5).mean() > 0.93
