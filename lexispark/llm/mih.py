"""Exact top-k Hamming search by incremental multi-index hashing (operator 1).

Codes of up to 64 bits are cut into segments; a table lists the codes by the value of each segment. A query probes all
segment values within radius 0, then 1, and so on, one segment at a time. Once segments 0..j have been probed at radius r and
the others at r - 1, every code within ``segments * r + j`` is verified; the search ends when that covers the k-th verified
distance, so the k nearest by (distance, id) are exact.

Execution: the indexed rows stay where they are. Each task takes its rows in blocks of at most ``BLOCK_ROWS`` distinct codes,
builds the tables of a block, and searches them for all queries, starting from the k-th distance that earlier blocks gave. The
queries, a stated set, are sent in chunks of at most ``QUERY_CHUNK`` codes (1 MB), one pass over the index each. A task returns
at most k rows a query, and a partial top-k merges them.

Defined cases: rows without a code or id are neither indexed nor asked; repeated (id, code) rows each count; ties go to the
smaller id; fewer rows than k give as many; an empty table gives no rows; a query that is itself indexed finds itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk

_U = np.uint64
K = 10
BLOCK_ROWS, QUERY_CHUNK = 1 << 17, 1 << 16


def sign_code(vector: str, bits: int) -> Column:
    """Bit i (from the least) is set where component i is positive; null where the vector or a component is null, or of another size."""
    v = F.col(f"`{vector}`")
    packed = F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.when(F.get(v, i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )
    return F.when((F.size(v) == bits) & ~F.exists(v, lambda x: x.isNull()), packed)


def _masks(width: int) -> list[np.ndarray]:
    """All values of ``width`` bits by number of set bits."""
    values = np.arange(1 << width, dtype=np.int64)
    ones = np.bitwise_count(values)
    return [values[ones == r] for r in range(width + 1)]


class Tables:
    """The segment tables of one block of distinct codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        width = int(np.clip(np.log2(max(2, len(codes))), 4, 16))
        self.segments = -(-bits // width)
        edges = np.linspace(0, bits, self.segments + 1).round().astype(int)
        self.parts = []
        for lo, hi in zip(edges, edges[1:]):
            value = ((codes >> _U(lo)) & _U((1 << (hi - lo)) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            bounds = np.searchsorted(value[order], np.arange((1 << (hi - lo)) + 1))
            self.parts.append((int(lo), int(hi - lo), order, bounds))
        self.masks = {w: _masks(w) for w in {p[1] for p in self.parts}}

    def search(self, query: np.uint64, copies: np.ndarray, k: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (and distances) that hold the k nearest rows, or all rows within ``limit`` if fewer; ``copies``: rows of each code."""
        seen = np.zeros(len(self.codes), dtype=bool)
        found, dist = [], []
        count = np.zeros(self.bits + 2, dtype=np.int64)
        for r in range(max(p[1] for p in self.parts) + 1):
            for j, (lo, width, order, bounds) in enumerate(self.parts):
                if r <= width:
                    value = ((int(query) >> lo) & ((1 << width) - 1)) ^ self.masks[width][r]
                    a, b = bounds[value], bounds[value + 1]
                    some = b > a
                    if some.any():
                        cand = _concat(order, a[some], b[some])
                        cand = cand[~seen[cand]]
                        seen[cand] = True
                        d = np.bitwise_count(self.codes[cand] ^ query)
                        found.append(cand)
                        dist.append(d)
                        count[: self.bits + 1] += np.bincount(d, weights=copies[cand], minlength=self.bits + 1).astype(np.int64)[: self.bits + 1]
                covered = self.segments * r + j
                reach = int(np.searchsorted(np.cumsum(count), k))  # the k-th distance so far
                if covered >= min(reach, limit):
                    i, d = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(dist or [np.zeros(0, np.uint8)])
                    keep = d <= min(reach, limit)
                    return i[keep], d[keep]
        i, d = np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(dist or [np.zeros(0, np.uint8)])
        keep = d <= limit
        return i[keep], d[keep]


def _concat(order: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return order[tk.ranges(a, b - a)]


def _search(queries, k: int, bits: int, block_rows: int):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes = queries.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]  # distances, ids
        held: list[pa.RecordBatch] = []

        def block():
            own = np.concatenate([b.column(0).to_numpy() for b in held])
            code = np.concatenate([b.column(1).to_numpy() for b in held]).view(np.uint64)
            order = np.lexsort((own, code))
            own, code = own[order], code[order]
            distinct, start, copies = np.unique(code, return_index=True, return_counts=True)
            tables = Tables(distinct, bits)
            for q, query in enumerate(codes):
                d0, i0 = best[q]
                limit = int(d0[-1]) if len(d0) == k else bits
                at, d = tables.search(query, copies, k, limit)
                # of rows with one code, the k smallest ids suffice
                take = np.minimum(copies[at], k)
                rows = own[np.repeat(start[at], take) + _within(take)]
                d1, i1 = np.concatenate([d0, np.repeat(d, take).astype(np.int64)]), np.concatenate([i0, rows])
                first = np.lexsort((i1, d1))[:k]
                best[q] = (d1[first], i1[first])

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= block_rows:
                block()
                held, size = [], 0
        if size:
            block()
        for lo in range(0, len(ids), 4096):
            some = best[lo : lo + 4096]
            n = [len(d) for d, _ in some]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 4096], n)), pa.array(np.concatenate([i for _, i in some])), pa.array(np.concatenate([d for d, _ in some]).astype(np.int32))], schema=schema)

    return run


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def top_k(index: DataFrame, queries: DataFrame, k: int = K, bits: int = 64, id_col: str = "id", code_col: str = "code", block_rows: int = BLOCK_ROWS, query_chunk: int = QUERY_CHUNK) -> DataFrame:
    """(query_id, rank, id, distance): for each query row the k indexed rows nearest by (distance, id).

    Query ids must be unique; ``queries`` is fetched a chunk at a time.
    """
    spark = index.sparkSession
    columns = [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{code_col}`").cast("long").alias("code")]
    rows = index.select(*columns).dropna()
    asked = queries.select(*columns).dropna().dropDuplicates(["id"])
    chunks = max(1, -(-asked.count() // query_chunk))
    out = None
    for c in range(chunks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).orderBy("id").toArrow()
        state = spark.sparkContext.broadcast((part.column("id").to_numpy(), part.column("code").to_numpy().view(np.uint64)))
        near = rows.mapInArrow(tk.lean(_search(state, k, bits, block_rows)), "query_id long, id long, distance int")
        out = near if out is None else out.unionByName(near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
