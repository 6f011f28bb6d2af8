"""Exact vector retrieval in blocks, and vector pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .scores import top_k

#: Query vectors in one broadcast block, and scores that a task holds at a time.
QUERY_BLOCK, STEP = 4096, 1_000_000


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """L2-normalised; the zero vector stays zero."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, doc_id: str = "vec_id", vector: str = "embedding", qid: str = "qid", query_vector: str = "embedding") -> DataFrame:
    """(qid, doc_id, score, rank): exact inner products, all queries at once.

    Vectors stay where they are and are multiplied with one block of query vectors at a time, in steps of bounded size; a task
    keeps and returns only its own k best per query, which a partial and a final limit then merge.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(qid).cast("long").alias("qid"), F.col(query_vector).alias("v")).dropna()
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    schema = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
    out = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        ids = part.column("qid").to_numpy()
        state = spark.sparkContext.broadcast((ids, np.array(part.column("v").to_pylist(), dtype=np.float64).reshape(len(ids), -1)))

        def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            qids, q = state.value
            if not len(qids):
                return
            best = None
            for batch in batches:
                for lo in range(0, batch.num_rows, max(1, STEP // len(qids))):
                    some = batch.slice(lo, max(1, STEP // len(qids)))
                    best = _merged(best, some.column(0).to_numpy(), q @ _matrix(some.column(1)).T, k)
            if best is not None:
                docs, s = best
                yield from pa.Table.from_arrays([pa.array(np.repeat(qids, docs.shape[1])), pa.array(docs.ravel()), pa.array(s.ravel())], schema=schema).to_batches(10_000)

        near = vectors.select(F.col(doc_id).cast("long"), F.col(vector)).dropna().mapInArrow(run, "qid long, doc_id long, score double")
        out = near if out is None else out.unionByName(near)
    return top_k(out, ["qid"], k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in doubles."""
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) != 1:
        raise ValueError(f"vectors of lengths {sizes.tolist()}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _merged(best: tuple[np.ndarray, np.ndarray] | None, docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores, a row for each query, of the k best of those so far and of the scores (queries x ids)."""
    ids = np.broadcast_to(docs, scores.shape)
    if scores.shape[1] > 4 * k:
        # what is below the k-th score by more than rounding goes before anything is rounded and sorted
        least = np.partition(scores, -k, axis=1)[:, -k]
        if best is not None and best[1].shape[1] >= k:
            least = np.maximum(least, best[1][:, k - 1])
        keep = ~(scores < least[:, None] - 2e-6)
        width = max(1, int(keep.sum(axis=1).max()))
        if width < scores.shape[1]:
            place = np.argsort(~keep, axis=1, kind="stable")[:, :width]
            ids, scores = np.take_along_axis(ids, place, axis=1), np.take_along_axis(scores, place, axis=1)
    scores = np.round(scores, 12)
    if best is not None:
        ids, scores = np.concatenate([best[0], ids], axis=1), np.concatenate([best[1], scores], axis=1)
    # ties in the rounded score go to the smaller id
    order = np.lexsort((ids, -np.round(scores, 6)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def mean_pool(chunks: DataFrame, key: str, vector: str, normalize_first: bool = False) -> DataFrame:
    """(key, pos, value): mean of a group's vectors, L2-normalised, as one row per component.

    Components are averaged by partial aggregation, so a group of any size costs a row per component and task.
    """
    v = normalized(F.col(vector)) if normalize_first else F.col(vector)
    means = chunks.select(F.col(key).alias("key"), F.posexplode(v).alias("pos", "x")).groupBy("key", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    length = means.groupBy("key").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("len"))
    return means.join(length, "key").select("key", "pos", F.when(F.col("len") > 0, F.col("mean") / F.col("len")).otherwise(F.lit(0.0)).alias("value"))


def pooled_vectors(means: DataFrame) -> DataFrame:
    """(key, embedding) from the rows of ``mean_pool``: a vector's components are few."""
    return means.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("embedding"))
