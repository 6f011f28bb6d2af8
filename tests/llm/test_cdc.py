import random
import re

import numpy as np

from lexispark.llm import cdc


def brute_chunks(raw):
    """The cutting rule, a byte at a time."""
    space = {0x20, 9, 10, 11, 12, 13}
    gear = [int(x) for x in cdc._GEAR]
    cuts, last = [0], 0
    for p in range(1, len(raw)):
        if p - last < cdc.WINDOW:
            continue
        h = 0
        for b in raw[p - cdc.WINDOW : p]:
            h = ((h << 1) + gear[b]) & 0xFFFFFFFF
        # a sum over the window only, as older bytes have left the bits that the masks read
        word = raw[p] not in space and raw[p - 1] in space and h & int(cdc.WORD_MASK) == 0
        char = raw[p] & 0xC0 != 0x80 and h & int(cdc.CHAR_MASK) == 0
        if word or char:
            while p - last > cdc.MOST_BYTES:
                last += cdc.MOST_BYTES
                while raw[last] & 0xC0 == 0x80:
                    last -= 1
                cuts.append(last)
            if p > last:
                cuts.append(p)
                last = p
    while len(raw) - last > cdc.MOST_BYTES:
        last += cdc.MOST_BYTES
        while raw[last] & 0xC0 == 0x80:
            last -= 1
        cuts.append(last)
    return [raw[a:b] for a, b in zip(cuts, cuts[1:] + [len(raw)])] if raw else []


def words_of(before, run):
    """Words that start in the run, given the byte before it."""
    return len(re.findall(rb"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]", before + run))


def brute(rows):
    seen, out = set(), {}
    for i, (doc_id, text) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        parts = brute_chunks((text or "").encode())
        two = list(zip(parts, parts[1:])) or [(p,) for p in parts]
        flags = [t in seen or seen.add(t) is not None for t in two]
        gone, k = set(), 0
        while k < len(two):
            j = k
            while j < len(two) and flags[j]:
                j += 1
            if j > k:
                last = j + len(two[0]) - 1
                run = b"".join(parts[k:last])
                if words_of(b" " if k == 0 else parts[k - 1][-1:], run) >= cdc.RUN_WORDS or len(run) >= cdc.RUN_BYTES:
                    gone |= set(range(k, last))
            k = j + 1
        out[i] = None if text is None else b"".join(p for n, p in enumerate(parts) if n not in gone).decode()
    return out


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 90))) for _ in range(6)]
    rows = []
    for i in range(80):
        text = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 2:
            text += "\n" + rng.choice(passages) + " " + " ".join(word() for _ in range(5))
        rows.append((i * 7 % 80, text))
    return rows + [(200, None), (201, ""), (202, "x" * 3000), (203, "é" * 2000), (204, rows[1][1]), (None, rows[3][1]), (205, "the same words again " * 40)], passages


def test_against_brute_force(spark):
    rows, _ = corpus()
    df = spark.createDataFrame([(k, *r, i) for i, (k, r) in enumerate((i, r) for i, r in enumerate(rows))], "row long, doc_id long, text string, n_chunks long")
    got = {r.row: r for r in cdc.dedup_substrings(df, block_bytes=3000).collect()}
    want = brute(rows)
    assert {k: r.text for k, r in got.items()} == want
    for k, r in got.items():
        text = rows[k][1] or ""
        kept = "".join(text[a:b] for a, b in zip([0, *[s.end for s in r.removed]], [*[s.start for s in r.removed], len(text)]))
        assert kept == (r.text or "") and r.n_removed_chars == len(text) - len(kept)
        assert r.n_chunks == len(brute_chunks(text.encode()))


def test_repeated_passages_go_and_the_rest_stays(spark):
    rows, passages = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in cdc.dedup_substrings(df).collect()}
    for p in passages:
        holders = sorted(i for i, t in rows if t and p in t and i is not None)
        assert p in got[holders[0]]
        for i in holders[1:]:
            assert " ".join(p.split()[12:-12]) not in got[i]
    for i, t in rows:
        if i is not None and t and not any(p in t for p in passages) and i < 200:
            assert got[i] == t


def test_short_phrases_in_any_order_stay(spark):
    """Phrases of a few words that all occur elsewhere, in orders that do not, cost no text anything."""
    rng = random.Random(3)
    phrases = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6)) for _ in range(40)]
    texts = [" ".join(rng.sample(phrases, 12)) for _ in range(60)]
    got = {r.doc_id: r.text for r in cdc.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(got[i] == t for i, t in enumerate(texts)) >= 58


def test_cuts_fall_into_step_after_an_insertion():
    rng = np.random.default_rng(2)
    a = bytes(rng.choice(list(b"abcdef     "), 4000).astype(np.uint8))
    b = a[:1000] + b"zz inserted zz" + a[1000:]
    x, y = (np.frombuffer(t, dtype=np.uint8) for t in (a, b))
    ca, cb = cdc.chunks(x, np.array([0, len(a)]))[0], cdc.chunks(y, np.array([0, len(b)]))[0]
    assert len(set(ca[ca > 1200]) - set(cb - 14)) == 0


def test_empty(spark):
    assert cdc.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
