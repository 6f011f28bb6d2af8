import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import textkernel as tk
from lexispark.llm import toxicity
from lexispark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(8)
    words = ["idiot", "moron", "scum", "clown", "éclown", "trash", "trashy", "ab", "réeuxpa", "ünsäß", "жовно"]
    auto = toxicity.Automaton(words)
    texts = words + [w.upper() for w in words]
    for w in words:
        for _ in range(60):
            v = list(w)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(v) + 1)
                rng.choice([lambda: v.insert(k, rng.choice("aéxt")), lambda: v.pop(k) if k < len(v) else 0, lambda: v.__setitem__(k, rng.choice("aéx")) if k < len(v) else 0])()
            if v:
                texts.append("".join(v))
    data, offsets = tk.buffers(pa.array(texts))
    i, w, e = auto.run(data, offsets[:-1], offsets[1:])
    got = dict(zip(i.tolist(), zip(w.tolist(), e.tolist())))
    texts_lower = ["".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    for k, t in enumerate(texts_lower):
        near = [(d, j) for j, x in enumerate(words) if (d := distance(t, x)) <= (1 if len(x) >= toxicity.FUZZY_FROM else 0)]
        assert got.get(k) == ((min(near)[1], min(near)[0]) if near else None), t


def test_letters_beyond_ascii_count_once_and_fold():
    auto = toxicity.Automaton(["énorme", "été"])
    texts = ["ÉNORME", "enorme", "ênorme", "nénorme", "ete", "ÉTÉ", "énoorrme"]
    data, offsets = tk.buffers(pa.array(texts))
    i, w, e = auto.run(data, offsets[:-1], offsets[1:])
    assert list(zip(i.tolist(), w.tolist(), e.tolist())) == [(0, 0, 0), (1, 0, 1), (2, 0, 1), (3, 0, 1), (5, 1, 0)]


def test_scores_per_text_against_brute_force():
    """The totals of each text from a plain loop over its words."""
    rng = random.Random(4)
    words, weights = ["idiot", "crétin", "scum"], [5.0, 4.0, 3.0]
    m = toxicity.Matcher(words, weights)
    pool = ["idiot", "Idiiot", "CRÉTIN", "cretin", "scum", "scam", "fine", "day", "said", "tree", '"', "new\nline"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    x = m.features(*tk.buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        sums = {"abuse_total": 0.0, "misspelled_total": 0.0, "quoted_total": 0.0}
        spans = [(w.start(), w[0]) for w in re.finditer(r'[^\s"]+', t)]
        for j, (at, word) in enumerate(spans):
            near = [(d, n) for n, y in enumerate(words) if (d := distance(word.lower(), y)) <= (1 if len(y) >= toxicity.FUZZY_FROM else 0)]
            if not near:
                continue
            d, n = min(near)
            line = t[t.rfind("\n", 0, at) + 1 :].split("\n")[0]
            before = t[t.rfind("\n", 0, at) + 1 : at].count('"')
            quoted = before % 2 == 1 and line.count('"') > before or any(s.lower() in toxicity.REPORTING for _, s in spans[max(0, j - 4) : j + 5] if s != word)
            sums["quoted_total" if quoted else "misspelled_total" if d else "abuse_total"] += weights[n]
        for name, total in sums.items():
            assert x[k, toxicity.NAMES.index(name)] == pytest.approx(np.log1p(total)), (t, name)


def test_quotation_and_windows():
    m = toxicity.Matcher(["idiot", "clown"], [5.0, 4.0])
    i = toxicity.NAMES.index
    texts = ["you idiot and clown here", 'it is the "idiot and clown" there', "they said idiot here", "an idiiot here is", None, "clean", "a «clown» b", '"open idiot here']
    x = m.features(*tk.buffers(pa.array(texts)))
    assert (x[:, i("abuse_total")] > 0).tolist() == [True, False, False, False, False, False, False, True]
    assert (x[:, i("quoted_total")] > 0).tolist() == [False, True, True, False, False, False, True, False]
    assert (x[:, i("misspelled_total")] > 0).tolist() == [k == 3 for k in range(8)]
    assert x[0, i("kinds")] == np.log1p(2)
    far = m.features(*tk.buffers(pa.array(["idiot " + "w " * 100 + "idiot", "idiot w idiot"])))
    assert far[0, i("densest_window")] < far[1, i("densest_window")]


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = QUERIES["op7_toxicity"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted for r in held if r.toxic]) > 0.85
    assert np.mean([r.predicted for r in held if not r.toxic]) < 0.02


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (1, None, 9), (2, "", 9), (None, "a b", 9), (3, "bad words " * 50_000, 9)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(False))
    got = toxicity.annotate(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.annotate(docs, toxicity.fit(docs, labels.limit(0), F.lit(False))).collect()} == {0.0}
    assert toxicity.annotate(docs.limit(0), model).count() == 0
