"""Quality classifier by positive-unlabelled learning (operator 3).

Trusted positives are rows that the labels mark 1; every other text is unlabelled web text. The class prior is estimated by
best-bin estimation on held-out halves, and a small network minimises the non-negative unbiased PU risk. Label 0 is never
read. Inputs are shape and repetition statistics of the whole text; labels, language, source and id are no inputs.

The learner sees at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts, those with the smallest hash of the id among
the training rows; all statistics of a text cover the whole text, and every text is scored in one scan without a shuffle.

Defined cases: null and empty texts get the score of a text without words; a text of any length is read whole, alone in its slice if it is long; null ids are scored and count as held out;
repeated rows stay repeated; without any positive the score is the neutral 0.5; an empty table gives an empty result;
further columns are ignored (``annotate`` carries them on and replaces columns named as its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, learn
from . import textkernel as tk

_U = np.uint64
SAMPLE, THRESHOLD = 8000, 0.3

_KIND = np.zeros(256, dtype=np.int8)  # 0 white space, 1 lower or non-ASCII, 2 upper, 3 digit, 4 sentence marks, 5 other
_KIND[:] = 1
_KIND[:128] = 5
_KIND[tk.SPACE] = 0
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:?!'\"()-"]] = 4

NAMES = ["log_words", "log_bytes", "word_length", "upper", "digit", "mark", "other", "space", "lines", "line_repeats", "next_same", "second_same", "word_repeats", "pair_repeats", "top_word", "other_ended", "mark_ended", "no_letter", "long_word", "non_ascii"]


def _repeats(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document's items: how many repeat an earlier one, and the count of the most frequent."""
    keys, first, count = np.unique(tk.mix64(h ^ (doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15))), return_index=True, return_counts=True)
    of = doc[first]
    top = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(top, of, count)
    return np.bincount(of, weights=count - 1, minlength=n_docs), top


_LINE_ENDS = np.zeros(256, dtype=bool)
_LINE_ENDS[[0x0A, 0x0D]] = True


def features(data: np.ndarray, offsets: np.ndarray, hasher: tk.SpanHash) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    kind = _KIND[data]
    share = lambda k: tk.sums(kind == k, offsets) / size
    starts, ends, at = tk.spans(data, offsets)
    words = np.diff(at)
    some, length = np.maximum(words, 1), ends - starts
    doc = np.repeat(np.arange(n), words)
    h = hasher(data, starts, ends)
    last = kind[ends - 1] if len(ends) else kind[:0]
    same = lambda k: np.bincount(doc[k:][(h[k:] == h[:-k]) & (doc[k:] == doc[:-k])], minlength=n) / some if len(h) > k else np.zeros(n)
    again, top = _repeats(doc, h, n)
    pair = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    pairs, _ = _repeats(doc[1:][pair], tk.mix64(h[:-1][pair] * _U(3) + h[1:][pair]), n)
    ls, le, lat = tk.spans(data, offsets, _LINE_ENDS)
    lines = np.diff(lat)
    line_again, _ = _repeats(np.repeat(np.arange(n), lines), hasher(data, ls, le), n)
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    per_word = lambda x: tk.sums(x, at) / some
    return np.stack(
        [
            np.log1p(words), np.log1p(np.diff(offsets)), tk.sums(length, at) / some, share(2), share(3), share(4), share(5), share(0), lines / some,
            line_again / np.maximum(lines, 1), same(1), same(2), again / some, pairs / some, top / some, per_word(last == 5), per_word(last == 4),
            per_word(letters[ends] == letters[starts]), per_word(length > 30), tk.sums(data >= 0x80, offsets) / size,
        ],
        axis=1,
    )


def _extract(df: DataFrame) -> DataFrame:
    """(key, x) for rows (key, text)."""
    schema = pa.schema([("key", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.SpanHash()
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, "text"):
                x = features(data, offsets, hasher)
                yield pa.RecordBatch.from_arrays([rows.column("key"), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))], schema=schema)

    return df.mapInArrow(tk.lean(run), "key long, x array<double>")


def sampled(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """The ``most`` ids with the smallest hashes (column key); each id once."""
    return ids.distinct().orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(most)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> learn.Net | None:
    """Learns from the rows of ``docs`` where ``held_out`` (an expression over ``key``) is false; None without positives."""
    common.short_batches(docs.sparkSession)
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text")).filter(F.col("key").isNotNull() & ~held_out)
    trusted = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{label_id_col}`").cast("long").alias("key")).filter(F.col("key").isNotNull() & ~held_out)
    positive = sampled(trusted, sample, 1).withColumn("positive", F.lit(True)).withColumn("seen", F.lit(False))
    web = sampled(d.select("key"), sample, 2).withColumn("positive", F.lit(False)).withColumn("seen", F.lit(True))
    picked = positive.unionByName(web).groupBy("key").agg(F.max("positive").alias("positive"), F.max("seen").alias("seen"))
    picked = picked.sparkSession.createDataFrame(picked.collect(), "key long, positive boolean, seen boolean")  # 2 * sample rows at most
    rows = _extract(d.join(F.broadcast(picked.select("key")), "key", "left_semi")).join(F.broadcast(picked), "key").toPandas()
    rows = rows.drop_duplicates("key").sort_values("key")
    x = np.array(rows.x.tolist()) if len(rows) else np.zeros((0, len(NAMES)))
    p, u = x[rows.positive.to_numpy(dtype=bool)], x[rows.seen.to_numpy(dtype=bool)]
    if not len(p) or not len(u):
        return None
    # prior from a classifier of positives against unlabelled, each half judged by the other half's model
    scores = []
    for a, b in ((0, 1), (1, 0)):
        pa_, ua = p[a::2] if len(p) > 1 else p, u[a::2] if len(u) > 1 else u
        both = np.concatenate([pa_, ua])
        y = np.repeat([1.0, 0.0], [len(pa_), len(ua)])
        model = learn.Logistic(both, y, np.where(y > 0, 1 / len(pa_), 1 / len(ua)) * len(y) / 2)
        scores.append((model(p[b::2] if len(p) > 1 else p), model(u[b::2] if len(u) > 1 else u)))
    prior = learn.estimate_prior(*(np.concatenate(s) for s in zip(*scores)))
    return learn.fit_nnpu(p, u, prior)


def annotate(docs: DataFrame, model: learn.Net | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on)."""
    common.short_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    state = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = tk.SpanHash()
        for batch in batches:
            for rows, data, offsets in tk.slices(batch, text_col):
                score = np.full(rows.num_rows, 0.5) if state.value is None else state.value(features(data, offsets, hasher))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*rows.schema.names, "score", "predicted"])

    return docs.mapInArrow(tk.lean(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def keep_good(docs: DataFrame, model: learn.Net | None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; their columns are unchanged."""
    return common.around(docs, ["score", "predicted"], lambda d: annotate(d, model, text_col, threshold).filter("predicted = 1"))


def held_out(column: str = "key", folds: int = 5, rest: int = 0) -> Column:
    """True where crc32 of the id as text leaves ``rest`` modulo ``folds``, and for null ids."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == rest, F.lit(True))
