"""Benchmark decontamination by winnowing (operator 10).

Words: runs of ASCII letters, digits and non-ASCII characters of the text with A-Z lower-cased. Documents and benchmark items
keep the least of every ``span - gram + 1`` consecutive ``gram``-word hashes (ties all kept), so any ``span`` words that both
share contain a fingerprint that both keep. Fingerprints are joined (hash table in the task), and each hit is extended: the
``span``-word windows around it are looked up among the benchmark's windows. Items of fewer words than ``span`` are one window
each and are looked up at every position by their own length. Documents are never shuffled.

A benchmark of up to ``MOST_WINDOWS`` windows reaches the tasks as one hash table, and documents are scanned once, without a
shuffle. A larger one is joined by shuffles: the documents' fingerprints that pass a bit table of fixed size are semi-joined with
the benchmark's, the texts that are left give their windows, these are joined with the benchmark's windows, and the results
return to the rows by a key of the text.

Defined cases: null or empty texts have no words and no hits; a text of any length is read whole, alone in its slice if it is long; an item without words never occurs; a null item id reads as the
empty string; repeated item ids are one item; repeated documents stay repeated; an empty benchmark or table gives no hits or
no rows; further columns are ignored (``annotate`` carries them on, its own columns replace any of the same name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import textkernel as tk

_U = np.uint64
SPAN, GRAM = 10, 5
#: Windows and fingerprints of a benchmark that a task holds (about 40 MB), and bits of the table of a larger one.
MOST_WINDOWS, FILTER_BITS = 1 << 20, 27

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())]


def gram_hashes(h: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n words from each position (of ``at``, or of all positions where n words follow)."""
    if at is None:
        at = slice(0, max(0, len(h) - n + 1))
        take = lambda j: h[at.start + j : at.stop + j]
    else:
        take = lambda j: h[at + j]
    acc = take(0) * _U(0x9E3779B97F4A7C15)
    for j in range(1, n):
        acc = (acc + take(j)) * _U(0x9E3779B97F4A7C15)
    return tk.mix64(acc + _U(n))


def _valid(at: np.ndarray, n: int) -> np.ndarray:
    """Positions from which n words of the same document follow."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    return tk.ranges(at[:-1], counts)


def winnowed(h: np.ndarray, at: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of every document that has ``span`` words."""
    g = gram_hashes(h, gram)
    first = _valid(at, span)
    if not len(first):
        return first, np.zeros(0, dtype=np.uint64)
    width = span - gram + 1
    low = g[first]
    for j in range(1, width):
        low = np.minimum(low, g[first + j])
    kept = np.zeros(len(g), dtype=bool)
    for j in range(width):
        kept[first[g[first + j] == low] + j] = True
    pos = np.flatnonzero(kept)
    return pos, g[pos]


class Lookup:
    """Membership in a fixed set of hashes: a bit table first, then a binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        bits = max(16, int(len(self.values)).bit_length() + 4)
        self.mask = _U((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[(self.values & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into ``h`` of members, and their indices in ``values``."""
        maybe = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        i = np.searchsorted(self.values, h[maybe])
        i[i == len(self.values)] = 0
        ok = self.values[i] == h[maybe]
        return maybe[ok], i[ok]


class Block:
    """Windows of benchmark items by length, with the items of each window, and the fingerprints of the full windows."""

    def __init__(self, lengths: np.ndarray, hashes: np.ndarray, items: np.ndarray, anchors: np.ndarray, span: int, gram: int):
        self.span, self.gram = span, gram
        self.anchors = Lookup(anchors)
        self.by_length = {}
        for n in np.unique(lengths):
            some = lengths == n
            order = np.argsort(hashes[some], kind="stable")
            h, who = hashes[some][order], items[some][order]
            look = Lookup(h)
            self.by_length[int(n)] = (look, np.searchsorted(h, look.values), np.searchsorted(h, look.values, "right"), who)

    def hits(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
        """(window length, window positions in the documents, their numbers in the block's table, table)."""
        for n, table in self.by_length.items():
            if n == self.span:
                pos, g = winnowed(h, at, self.gram, self.span)
                near = pos[self.anchors.find(g)[0]]
                if not len(near):
                    continue
                first = (near[:, None] - np.arange(self.span - self.gram + 1)[None, :]).ravel()
                first = np.unique(first[first >= 0])
                doc = np.searchsorted(at, first, "right") - 1
                first = first[first + n <= at[doc + 1]]
            else:
                first = _valid(at, n)
            if len(first):
                i, which = table[0].find(gram_hashes(h, n, first))
                if len(i):
                    yield n, first[i], which, table


def _packed_items(span: int, gram: int):
    """Rows (item, n, hash, anchor): every window of every item and, with anchor set, every fingerprint."""
    schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("anchor", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.SpanHash()
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, "text"):
                h, at = tk.token_hashes(data, offsets, hasher, tk.NON_ALNUM)
                names = np.array(rows.column("item").fill_null("").to_pylist(), dtype=object)
                for d in range(len(names)):
                    own = h[at[d] : at[d + 1]]
                    if not len(own):
                        continue
                    n = min(span, len(own))
                    wins = np.unique(gram_hashes(own, n))
                    marks = np.unique(winnowed(own, np.array([0, len(own)]), gram, span)[1]) if n == span else wins[:0]
                    both = np.concatenate([wins, marks])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[d]] * len(both), pa.string()), pa.array(np.full(len(both), n, np.int32)), pa.array(both.view(np.int64)), pa.array(np.arange(len(both)) >= len(wins))], schema=schema
                    )

    return run


def _table(rows: DataFrame) -> tuple:
    """Names and the arguments of Block; of a checked number of rows."""
    part = rows.toArrow()
    names, items = np.unique(np.array(part.column("item").to_pylist(), dtype=object).astype(str), return_inverse=True)
    n, h, mark = part.column("n").to_numpy(), part.column("hash").to_numpy().view(np.uint64), part.column("anchor").to_numpy(zero_copy_only=False)
    return list(map(str, names)), n[~mark], h[~mark], items[~mark], h[mark]


def _digest(who) -> str:
    return hashlib.sha256(",".join(sorted(who)).encode()).hexdigest()


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    common.short_batches(docs.sparkSession)
    items = benchmark.select(F.col(f"`{item_id_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("text"))
    windows = common.stored(items.mapInArrow(tk.lean(_packed_items(span, gram)), "item string, n int, hash long, anchor boolean"), name="windows")
    own = [f.name for f in docs.schema if f.name not in {n for n, _ in _FIELDS}]
    docs = docs.select(*[F.col(f"`{c}`") for c in own])
    if windows.count() > most_windows:
        return _joined(docs, windows, text_col, span, gram)
    held = docs.sparkSession.sparkContext.broadcast(_table(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, names, table = tk.SpanHash(), held.value[0], Block(*held.value[1:], span, gram)
        clean = _digest(())
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, text_col):
                h, at = tk.token_hashes(data, offsets, hasher, tk.NON_ALNUM)
                n_docs = len(offsets) - 1
                edge = np.zeros(len(h) + 1, dtype=np.int64)
                found: dict[int, set[str]] = {}
                for n, first, which, (_, lo, hi, who) in table.hits(h, at):
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n, -1)
                    doc = np.searchsorted(at, first, "right") - 1
                    pairs = np.unique(np.stack([doc, which]), axis=1)
                    for d, w in pairs.T:
                        found.setdefault(int(d), set()).update(names[i] for i in who[lo[w] : hi[w]])
                covered = np.cumsum(edge[:-1]) > 0
                n_hit = tk.sums(covered, at)
                digest = np.full(n_docs, clean, dtype=object)
                n_items = np.zeros(n_docs, dtype=np.int64)
                for d, who in found.items():
                    n_items[d] = len(who)
                    digest[d] = _digest(who)
                new = [np.diff(at), n_hit, n_items, digest, n_hit > 0]
                yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(x, t) for x, (_, t) in zip(new, _FIELDS)]], names=[*rows.schema.names, *[n for n, _ in _FIELDS]])

    return docs.mapInArrow(tk.lean(run), _with(docs, RESULT))


def _with(docs: DataFrame, more: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, *T._parse_datatype_string(more).fields])


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - FILTER_BITS)).astype(np.int64)


def _filter(marks: DataFrame) -> np.ndarray:
    """A bit for each prefix of the hashes: 16 MB whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            seen[_bits(batch.column(0).to_numpy().view(np.uint64))] = True
        cells = np.packbits(seen).reshape(1024, -1)
        some = np.flatnonzero(cells.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([cells[i].tobytes() for i in some], pa.binary())], names=["cell", "bits"])

    def add(table: pa.Table) -> pa.Table:
        both = np.bitwise_or.reduce([np.frombuffer(b.as_py(), dtype=np.uint8) for b in table.column("bits")])
        return pa.Table.from_arrays([table.column("cell")[:1], pa.array([both.tobytes()], pa.binary())], names=["cell", "bits"])

    cells = marks.select("hash").mapInArrow(tk.lean(run), "cell int, bits binary").groupBy("cell").applyInArrow(add, "cell int, bits binary").collect()
    out = np.zeros((1024, (1 << FILTER_BITS) // 8192), dtype=np.uint8)
    for r in cells:
        out[r.cell] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def _joined(docs: DataFrame, windows: DataFrame, text_col: str, span: int, gram: int) -> DataFrame:
    """``annotate`` for a benchmark of any size, by joins on fingerprints and windows."""
    spark = docs.sparkSession
    lengths = sorted(r.n for r in windows.filter("not anchor").select("n").distinct().collect())  # 1 to span
    # what leads to a window: fingerprints of full ones, short ones themselves
    marks = windows.filter(F.col("anchor") | (F.col("n") < span))
    known = spark.sparkContext.broadcast(_filter(marks))
    key = [F.xxhash64(F.lit(k), F.col(f"`{text_col}`")).alias(f"k{k}") for k in (1, 2)]
    texts = docs.select(*key, F.col(f"`{text_col}`").alias("text"))

    def each(windows_too: bool):
        """Rows (k1, k2, n, pos, hash): of each text the distinct fingerprints that pass the table, or all windows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher, bits = tk.SpanHash(), known.value
            for batch in batches:
                for rows, data, offsets in tk.slices(batch, "text"):
                    h, at = tk.token_hashes(data, offsets, hasher, tk.NON_ALNUM)
                    k1, k2 = (rows.column(c).to_numpy() for c in ("k1", "k2"))
                    for n in lengths:
                        if n == span and not windows_too:
                            first, g = winnowed(h, at, gram, span)
                        else:
                            first = _valid(at, n)
                            g = gram_hashes(h, n, first) if len(first) else np.zeros(0, np.uint64)
                        doc = np.searchsorted(at, first, "right") - 1
                        if not windows_too:
                            b = _bits(g)
                            ok = np.flatnonzero(bits[b >> 3] & (128 >> (b & 7)).astype(np.uint8))
                            ok = ok[np.sort(np.unique(np.stack([doc[ok], g[ok].view(np.int64)]), axis=1, return_index=True)[1])]
                            first, g, doc = first[ok], g[ok], doc[ok]
                        if len(g):
                            yield pa.RecordBatch.from_arrays([pa.array(k1[doc]), pa.array(k2[doc]), pa.array(np.full(len(g), n, np.int32)), pa.array(first - at[doc]), pa.array(g.view(np.int64))], names=["k1", "k2", "n", "pos", "hash"])

        return run

    row = "k1 long, k2 long, n int, pos long, hash long"
    prints = texts.mapInArrow(tk.lean(each(False)), row).select("k1", "k2", "hash")
    live = common.stored(prints.join(marks.select("hash").distinct(), "hash", "left_semi").select("k1", "k2").distinct(), name="live")
    some = texts.join(live, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("text").alias("text"))
    hits = some.mapInArrow(tk.lean(each(True)), row).join(windows.filter("not anchor").select("item", "n", "hash"), ["n", "hash"])
    # a text's covered words: ranges in order, each cut where the ones before it end
    spans = hits.groupBy("k1", "k2", "pos").agg(F.max("n").alias("n"))
    w = Window.partitionBy("k1", "k2").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("n")
    covered = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(F.max(end).over(w), F.lit(0))))).groupBy("k1", "k2").agg(F.sum("new").alias("n_hit"))
    who = hits.select("k1", "k2", "item").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256).alias("items_sha256"))
    result = common.stored(covered.join(who, ["k1", "k2"]), name="hits")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, text_col):
                _, _, at = tk.spans(data, offsets, tk.NON_ALNUM)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(at), pa.int64())], names=[*rows.schema.names, "n_words"])

    both = docs.mapInArrow(tk.lean(count), _with(docs, "n_words long")).withColumns({f"_k{k}": F.xxhash64(F.lit(k), F.col(f"`{text_col}`")) for k in (1, 2)})
    joined = both.join(result, (both["_k1"] == result["k1"]) & (both["_k2"] == result["k2"]), "left").drop("_k1", "_k2", "k1", "k2")
    zero = F.lit(0).cast("long")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest(()))).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; their columns are unchanged."""
    return common.around(docs, [n for n, _ in _FIELDS], lambda d: annotate(d, benchmark, **options).filter("not contaminated"))
