"""Toxicity scoring with Levenshtein automata over a lexicon trie (operator 7).

The lexicon is learned: words whose document frequency in toxic training texts exceeds that in other training texts by a
significant log-odds. Its trie is intersected with the Levenshtein automaton of distance 1 (words of ``FUZZY_FROM`` characters
and more; shorter ones must match exactly), giving one deterministic automaton over code points, lower-cased as the lexicon is,
that NumPy drives over all words of a slice at once. A match inside quotation marks, or near a reporting word, counts as quotation; the others as abuse. Densities, totals
and the densest window of both kinds go into a logistic regression.

The learner sees at most ``SAMPLE`` toxic and ``SAMPLE`` other training texts (those with the smallest hash of the id, in
their true proportion by weights). Features for the regression come from a lexicon of the other half of the sample. Every
whole text is scored in one scan without a shuffle.

Defined cases: null and empty texts have no matches; a text of any length is scored whole, alone in its slice if it is long; null ids are scored and count as held out; repeated rows stay repeated;
without toxic training rows the lexicon is empty and scores are near 0; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, learn, quality
from . import textkernel as tk

SAMPLE, LEXICON, THRESHOLD = 6000, 600, 0.7
FUZZY_FROM, WINDOW = 5, 30

#: Words of reporting and quoting near which a match counts as quotation (fixed values).
REPORTING = ["said", "says", "called", "quote", "quoted", "quoting", "wrote", "dit", "cite", "sagte", "sagt", "zitat", "dijo", "dice", "cita"]


@functools.cache
def _lower() -> np.ndarray:
    """The lower-case code point of each code point (itself where that is no single one)."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


class Automaton:
    """The deterministic automaton of a lexicon's words and their misspellings.

    A state is a set of (trie node, edits); state 0 is dead, state 1 the start. ``kind[code point]`` is the number of a
    character of the lexicon, upper or lower case, 0 for any other; ``table[state, kind]`` is the next state. ``word[state]`` is
    the best word accepted there (-1: none), ``edits[state]`` its distance.
    """

    def __init__(self, words: list[str]):
        self.words = words
        letters = {ord(c): k for k, c in enumerate(sorted(set("".join(words))), 1)}
        self.letters = letters
        self._kind = None
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        deep = [0]  # characters of the longest word below
        for i, w in enumerate(words):
            node = 0
            for c in w:
                deep[node] = max(deep[node], len(w))
                k = letters[ord(c)]
                if k not in children[node]:
                    children[node][k] = len(children)
                    children.append({})
                    ends.append(-1)
                    deep.append(0)
                node = children[node][k]
            deep[node] = max(deep[node], len(w))
            if ends[node] < 0:
                ends[node] = i
        size = [len(w) for w in words]
        fuzzy = lambda node: deep[node] >= FUZZY_FROM  # noqa: E731  some word below may be misspelled

        def close(nodes: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            out = set(nodes)
            for node, e in nodes:
                if e == 0:
                    out.update((c, 1) for c in children[node].values() if fuzzy(c))  # a character of the word is missing
            return frozenset((n, e) for n, e in out if e == 0 or (n, 0) not in out)

        def accept(state: frozenset[tuple[int, int]]) -> tuple[int, int]:
            found = [(e, ends[n]) for n, e in state if ends[n] >= 0 and (e == 0 or size[ends[n]] >= FUZZY_FROM)]
            return min(found, default=(0, -1))

        start = close({(0, 0)})
        number: dict[frozenset, int] = {frozenset(): 0, start: 1}
        width = len(letters) + 1
        queue, rows = [start], [np.zeros(width, dtype=np.int32)]
        words_at, edits_at = [-1, -1], [0, 0]

        def ident(state: frozenset) -> int:
            if state not in number:
                number[state] = len(number)
                queue.append(state)
                e, w = accept(state)
                words_at.append(w)
                edits_at.append(e)
            return number[state]

        at = 0
        while at < len(queue):
            state = queue[at]
            at += 1
            other = {(n, 1) for n, e in state if e == 0 and fuzzy(n)}  # a character too many
            for n, e in state:
                if e == 0:
                    other.update((c, 1) for c in children[n].values() if fuzzy(c))  # a character replaced
            row = np.full(width, ident(close(other)), dtype=np.int32)
            for b in {b for n, _ in state for b in children[n]}:
                row[b] = ident(close(other | {(children[n][b], e) for n, e in state if b in children[n]}))
            rows.append(row)
        self.table = np.stack(rows)
        self.word, self.edits = np.array(words_at, dtype=np.int32), np.array(edits_at, dtype=np.int8)

    def __getstate__(self):
        return self.__dict__ | {"_kind": None}

    @property
    def kind(self) -> np.ndarray:
        """Built where it is used; it is not sent around."""
        if self._kind is None:
            own = np.zeros(0x110000, dtype=np.uint16)
            own[list(self.letters)] = list(self.letters.values())
            self._kind = own[_lower()]
        return self._kind

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given spans of UTF-8 bytes: indices of those accepted, the word of each and its distance."""
        kinds = self.kind[np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        starts, ends = place[starts], place[ends]
        live = np.arange(len(starts))
        state = np.ones(len(starts), dtype=np.int32)
        found, at = [], 0
        while len(live):
            state = self.table[state, kinds[starts[live] + at]]
            at += 1
            alive = state > 0
            live, state = live[alive], state[alive]
            done = ends[live] == starts[live] + at
            if done.any():
                hit = done & (self.word[state] >= 0)
                found.append((live[hit], self.word[state[hit]], self.edits[state[hit]]))
                live, state = live[~done], state[~done]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int8)
        i, w, e = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(i)
        return i[order], w[order], e[order]


def _plain(data: np.ndarray) -> np.ndarray:
    """The bytes with typographic quotes and dashes blanked, so that they end words."""
    e2 = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    c2 = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
    if not len(e2) and not len(c2):
        return data
    out = data.copy()
    for at in (e2, e2 + 1, e2 + 2, c2, c2 + 1):
        out[at] = 0x20
    return out


def _quoted(data: np.ndarray, offsets: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether an opened quotation on the same line covers the position, and is closed on it."""
    mark = data == ord('"')
    wide = np.zeros(len(data), dtype=np.int8)  # 1 opens, -1 closes
    if len(data) > 2:
        e2 = (data[:-2] == 0xE2) & (data[1:-1] == 0x80)
        wide[:-2][e2 & ((data[2:] == 0x9C) | (data[2:] == 0x9E))] = 1
        wide[:-2][e2 & (data[2:] == 0x9D)] = -1
        c2 = data[:-1] == 0xC2
        wide[:-1][c2 & (data[1:] == 0xAB)] = 1
        wide[:-1][c2 & (data[1:] == 0xBB)] = -1
    if not mark.any() and not wide.any():
        return np.zeros(len(pos), dtype=bool)
    breaks = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    line = np.searchsorted(breaks, pos, "right") - 1
    lo, hi = breaks[line], breaks[np.minimum(line + 1, len(breaks) - 1)]
    marks = np.concatenate([[0], np.cumsum(mark)])
    opens, closes = np.concatenate([[0], np.cumsum(wide > 0)]), np.concatenate([[0], np.cumsum(wide < 0)])
    plain = ((marks[pos] - marks[lo]) % 2 == 1) & (marks[hi] > marks[pos])
    return plain | ((opens[pos] - opens[lo] > closes[pos] - closes[lo]) & (closes[hi] > closes[pos]))


NAMES = ["abuse_density", "abuse_total", "misspelled_density", "misspelled_total", "quoted_density", "quoted_total", "densest_window", "kinds", "log_words"]


class Matcher:
    """Features of texts under one lexicon."""

    def __init__(self, words: list[str], weights: np.ndarray):
        self.weights = np.asarray(weights, dtype=np.float64)
        self.automaton = Automaton(words)
        hasher = tk.SpanHash(seed=3)
        raw = np.frombuffer("".join(REPORTING).encode(), dtype=np.uint8)
        ends = np.cumsum([len(w) for w in REPORTING])
        self.hasher, self.reporting = hasher, np.sort(hasher(raw, ends - [len(w) for w in REPORTING], ends))

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        plain = _plain(data)
        starts, ends, at = tk.spans(plain, offsets, tk.NON_ALNUM)
        words = np.diff(at)
        out = np.zeros((n, len(NAMES)))
        out[:, 8] = np.log1p(words)
        if not len(self.weights):
            return out
        i, w, e = self.automaton.run(plain, starts, ends)
        if not len(i):
            return out
        doc = np.searchsorted(at, i, "right") - 1
        # the words around each match
        near = np.zeros(len(i), dtype=bool)
        for k in (-4, -3, -2, -1, 1, 2, 3, 4):
            j = i + k
            ok = (j >= at[doc]) & (j < at[doc + 1])
            h = self.hasher_of(plain, starts[j[ok]], ends[j[ok]])
            near[ok] |= np.isin(h, self.reporting)
        quoted = near | _quoted(data, offsets, starts[i])
        weight = self.weights[w]
        size = np.maximum(words, 5)
        add = lambda some: np.bincount(doc[some], weights=weight[some], minlength=n)
        for k, some in ((0, ~quoted & (e == 0)), (2, ~quoted & (e > 0)), (4, quoted)):
            total = add(some)
            out[:, k], out[:, k + 1] = np.sqrt(total / size), np.log1p(total)
        abuse = np.flatnonzero(~quoted & (e == 0))
        if len(abuse):
            run = np.concatenate([[0.0], np.cumsum(weight[abuse])])
            key = i[abuse] + doc[abuse] * (WINDOW + 1)  # no window reaches into the next text
            dense = run[np.searchsorted(key, key + WINDOW, "right")] - run[:-1]
            np.maximum.at(out[:, 6], doc[abuse], np.log1p(dense))
            kinds = np.unique(np.stack([doc[abuse], w[abuse]]), axis=1)[0]
            out[:, 7] = np.log1p(np.bincount(kinds, minlength=n))
        return out

    def hasher_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of a few spans: only their bytes are touched."""
        size = ends - starts
        flat = data[tk.ranges(starts, size)]
        stop = np.cumsum(size)
        return self.hasher(flat, stop - size, stop)


def lexicon(counts, toxic: int, other: int, most: int = LEXICON) -> tuple[list[str], np.ndarray]:
    """Words with significant log-odds, from rows (word, a, b): texts with the word among the toxic and the other ones."""
    a, b = counts.a.to_numpy(dtype=float), counts.b.to_numpy(dtype=float)
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (other + 1))
    sure = odds - 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    keep = np.flatnonzero((sure > 1.0) & (a >= 2))
    keep = keep[np.lexsort((counts.word.to_numpy()[keep], -sure[keep]))][:most]
    return list(counts.word.to_numpy()[keep]), np.minimum(odds[keep], 6.0)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[Matcher, learn.Logistic | None]:
    """Learns from labelled rows where ``held_out`` (an expression over ``key``) is false."""
    spark = docs.sparkSession
    common.short_batches(spark)
    known = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("key"), F.col(f"`{label_col}`").alias("toxic")).filter(F.col("key").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out)
    known = known.groupBy("key").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("key", F.lit(5)), "key").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    picked = spark.createDataFrame(picked.collect(), "key long, toxic int")  # 2 * sample rows at most
    half = F.pmod(F.xxhash64("key", F.lit(6)), F.lit(2)).cast("int")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(picked), "key").withColumn("half", half)
    words = texts.select("toxic", "half", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))).alias("word"))
    cell = lambda t, h: F.count_if((F.col("toxic") == t) & (F.col("half") == h))
    counts = words.groupBy("word").agg(*[cell(t, h).alias(f"c{t}{h}") for t in (0, 1) for h in (0, 1)])
    # a word far from significance leaves here; what stays is bounded by the sample's size
    table = counts.filter("c10 + c11 >= 2 and c10 + c11 > (c00 + c01) / 4").toPandas()
    sizes = {(r.toxic, r.half): r["count"] for r in texts.groupBy("toxic", "half").count().collect()}
    size = lambda t, h: sizes.get((t, h), 0)

    def matcher(halves: tuple[int, ...]) -> Matcher:
        c = table.assign(a=sum(table[f"c1{h}"] for h in halves), b=sum(table[f"c0{h}"] for h in halves))
        return Matcher(*lexicon(c, sum(size(1, h) for h in halves), sum(size(0, h) for h in halves)))

    final = matcher((0, 1))
    crossed = spark.sparkContext.broadcast([matcher((1,)), matcher((0,))])  # a text's lexicon comes from the other half
    schema = pa.schema([("key", pa.int64()), ("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, "text"):
                h = rows.column("half").to_numpy()
                both = [m.features(data, offsets) for m in crossed.value]
                x = np.where(h[:, None] == 0, both[0], both[1])
                yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("toxic").cast(pa.int32()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))], schema=schema)

    rows = texts.mapInArrow(tk.lean(extract), "key long, toxic int, x array<double>").toPandas().drop_duplicates("key").sort_values("key")
    y = rows.toxic.to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return final, None
    weight = np.where(y == 1, total.get(1, 0) / max(1, (y == 1).sum()), total.get(0, 0) / max(1, (y == 0).sum()))
    return final, learn.Logistic(np.array(rows.x.tolist()), y, weight / weight.mean())


def annotate(docs: DataFrame, model: tuple[Matcher, learn.Logistic | None], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    common.short_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, judge = state.value
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, text_col):
                score = np.zeros(rows.num_rows) if judge is None else judge(matcher.features(data, offsets))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"])

    return docs.mapInArrow(tk.lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(column: str = "key") -> Column:
    return quality.held_out(column, 3, 1)
