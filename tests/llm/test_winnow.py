import hashlib
import random
import re

import pytest

from lexispark.llm import winnow
from lexispark.llm.queries import ORACLES, QUERIES

from .oracle import same

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, who = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    who |= wins[tuple(w[i : i + k])]
        out.append((doc_id, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


def tables():
    rng = random.Random(3)
    vocabulary = ["the", "of", "Éa", "x1", "y"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 30, 60])))) for i in range(12)]
    items = [t for t in items if len(words(t[1])) > 2] + [(None, "of of of of the the the y y y y"), (4, None), (5, "!!"), (99, "zz, zz; zz-zz ZZ zz zz.zz zz zz zz zz")]
    docs = [(None, None), (1, ""), (2, "?!"), (3, "zz " * 500), (4, "q " * 60_000 + items[0][1])]
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            w += (rng.choice(items)[1] or "").split()
        docs.append((i, rng.choice([" ", ", ", "\n-"]).join(w)))
    return docs + docs[:2], items


@pytest.mark.parametrize("most", [winnow.MOST_WINDOWS, 20])
def test_against_brute_force(spark, most):
    docs, items = tables()
    d = spark.createDataFrame([(*x, 7) for x in docs], "doc_id long, text string, n_hit long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.annotate(d, b, most_windows=most).drop("text")
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_sql(spark):
    assert same(QUERIES["op10_winnow"](spark, SF), ORACLES["op10_winnow"], SF) == 200


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in winnow.annotate(d, b).collect()] == [False]
    assert winnow.annotate(d.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_long_texts_and_hot_windows_of_a_large_benchmark(spark):
    """A window that half of the items and many documents have, and a long text, by the join."""
    hot = " ".join(f"h{i}" for i in range(12))
    items = [(i, (hot if i % 2 else "") + " " + " ".join(f"i{i}x{j}" for j in range(15))) for i in range(60)] + [(99, "tiny item")]
    docs = [(i, f"a{i} b {hot if i % 3 else ''} c tiny item d " * (i % 4 + 1)) for i in range(90)] + [(100, "w " * 300_000 + hot)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = winnow.annotate(d, b, most_windows=0).drop("text")
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items))


def test_decontaminate(spark):
    d = spark.createDataFrame([(1, "a b", "en"), (2, "c a b d", "fr"), (3, "e", None)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, winnow.decontaminate(d, spark.createDataFrame([(1, "B, c")], "item_id long, text string")).collect())) == [(1, "a b", "en"), (2, "c a b d", "fr"), (3, "e", None)]
    assert sorted(map(tuple, winnow.decontaminate(d, spark.createDataFrame([(1, "A; b")], "item_id long, text string")).collect())) == [(3, "e", None)]
