"""SimHash near-duplicate detection with generalised-pigeonhole candidate search (operator 9).

Fingerprints: 3-word shingles (repeats included) of the lower-cased text, XXH64 with seed 42 each, bitwise majority.
Search: the 64 bits are cut into partitions of correlated bits; each partition i gets a threshold t_i >= -1 with
sum(t_i) = distance - partitions + 1, so two fingerprints within ``distance`` agree within t_i on some partition i
(general pigeonhole principle). Number of partitions and thresholds minimise the estimated work (rows to shuffle plus pairs
to verify) by dynamic programming over candidate counts that a bounded sample of fingerprints predicts; every fingerprint is
indexed and the result is exact whatever the estimate. Buckets are verified inside a task and leave as spanning forests, so a
group of n near copies costs at most n - 1 edges a bucket.

Defined cases: null text counts as empty; a text of any length is read whole, alone in its slice if it is long; texts without words share fingerprint zero and link like any other; a null id keeps
its row, links, and never names a component (``component_id`` is null where no id is reachable); repeated rows stay repeated;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as tk

_U = np.uint64
#: XXH64's published constants (fixed values).
P1, P2, P3, P4, P5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

#: Each byte's bits, one in each byte of a uint64.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]

#: More rows than this under one key are spread over block pairs.
HOT_ROWS = 8192
#: Fingerprints sampled to fit the index.
SAMPLE = 3000


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte spans at once."""
    n = len(starts)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    u64 = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    u32 = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    at, left = starts.astype(np.int64), lengths.astype(np.int64)
    acc = np.full(n, _U(seed) + P5, dtype=np.uint64)
    with np.errstate(over="ignore"):
        long = np.flatnonzero(left >= 32)
        if len(long):
            s = _U(seed)
            lanes = [np.full(len(long), v, dtype=np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
            pos, rest = at[long].copy(), left[long].copy()
            act = np.arange(len(long))
            while len(act):
                p = pos[act]
                for k in range(4):
                    lanes[k][act] = _rotl(lanes[k][act] + u64[p + 8 * k] * P2, 31) * P1
                pos[act] += 32
                rest[act] -= 32
                act = act[rest[act] >= 32]
            v = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for lane in lanes:
                v = (v ^ (_rotl(lane * P2, 31) * P1)) * P1 + P4
            acc[long] = v
            at, left = at.copy(), left.copy()
            at[long], left[long] = pos, rest
        acc += lengths.astype(np.uint64)
        for _ in range(3):
            act = np.flatnonzero(left >= 8)
            if not len(act):
                break
            acc[act] = _rotl(acc[act] ^ (_rotl(u64[at[act]] * P2, 31) * P1), 27) * P1 + P4
            at[act] += 8
            left[act] -= 8
        act = np.flatnonzero(left >= 4)
        if len(act):
            acc[act] = _rotl(acc[act] ^ (u32[at[act]].astype(np.uint64) * P1), 23) * P2 + P3
            at[act] += 4
            left[act] -= 4
        for _ in range(3):
            act = np.flatnonzero(left >= 1)
            if not len(act):
                break
            acc[act] = _rotl(acc[act] ^ (padded[at[act]].astype(np.uint64) * P5), 11) * P1
            at[act] += 1
            left[act] -= 1
        acc = (acc ^ (acc >> _U(33))) * P2
        acc = (acc ^ (acc >> _U(29))) * P3
        return acc ^ (acc >> _U(32))


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> np.ndarray:
    """The fingerprint of each text of one slice."""
    starts, ends, at = tk.spans(data, offsets)
    n_docs, words = len(offsets) - 1, np.diff(at)
    if not len(starts):
        return np.zeros(n_docs, dtype=np.uint64)
    inside = ~tk.SPACE[data]
    keep = inside.copy()
    keep[1:] |= ~inside[1:] & inside[:-1]
    low = tk.LOWER[data]
    low[~inside] = 0x20
    joined = low[keep]
    first = np.cumsum(keep)[starts] - 1
    last = first + (ends - starts)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    docs = np.flatnonzero(shingles)
    of = np.repeat(docs, shingles[docs])
    i = tk.ranges(at[:-1][docs], shingles[docs])
    j = np.minimum(i + width, at[1:][of]) - 1
    h = xxh64(joined, first[i], last[j] - first[i])
    return majority(h, shingles)


def majority(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles, ``counts`` of them; without any it is zero."""
    out = np.zeros(len(counts), dtype=np.uint64)
    docs = np.flatnonzero(counts)
    if not len(docs):
        return out
    bits = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
    bound = np.concatenate([[0], np.cumsum(counts[docs])])
    per = -(-counts[docs] // 255)  # a byte counts to 255
    cuts = np.repeat(bound[:-1], per) + 255 * tk.ranges(np.zeros(len(docs), dtype=np.int64), per)
    parts = np.add.reduceat(bits, cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    sums = np.add.reduceat(parts, np.concatenate([[0], np.cumsum(per)[:-1]]), axis=0)
    out[docs] = np.packbits(2 * sums > counts[docs][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row; fp is the fingerprint's bits as a signed long."""
    common.short_batches(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def each(rows, data, offsets):
        return {"doc_id": rows.column("doc_id"), "fp": fingerprints(data, offsets, width).view(np.int64)}

    return common.renamed(df, {id_col: "doc_id", text_col: "text"}).mapInArrow(tk.lean(tk.over_texts("text", each, schema)), "doc_id long, fp long")


@dataclass(frozen=True)
class Index:
    """Bit positions and threshold of each partition; thresholds below 0 need no probes."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def _extract(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fp), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> _U(b)) & _U(1)) << _U(k)
    return out


def _correlated(sample: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of bits, near equal in size, each grown greedily from its most correlated bits."""
    x = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & _U(1)).astype(np.float64)
    x -= x.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = np.inf
    corr = np.abs((x / norm).T @ (x / norm))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < size:
            b = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(b)
            free.remove(b)
        groups.append(tuple(sorted(group)))
    return groups


#: Relative costs of shuffling a row and of verifying a pair.
ROW_COST, PAIR_COST = 1.0, 0.03


def fit(sample: np.ndarray, total: int, distance: int = 3, most_parts: int = 4) -> Index:
    """Partitions and thresholds of least estimated cost for ``total`` distinct fingerprints."""
    best: tuple[float, Index] | None = None
    for m in range(2, max(2, min(most_parts, distance + 1)) + 1):
        parts = _correlated(sample, m) if len(sample) > 1 else [tuple(range(64))[k::m] for k in range(m)]
        cost = []
        for bits in parts:
            near = np.zeros(len(bits) + 1)
            v = _extract(sample, bits)
            for lo in range(0, len(v), 512):
                near += np.bincount(np.bitwise_count(v[lo : lo + 512, None] ^ v[None, :]).ravel(), minlength=len(bits) + 1)
            near[0] -= len(v)
            seen = np.cumsum(near) / max(1, len(v) * (len(v) - 1))
            chance = np.cumsum([math.comb(len(bits), t) for t in range(len(bits) + 1)]) / 2.0 ** len(bits)
            share = np.maximum(seen, chance)
            cost.append([0.0] + [ROW_COST * total * sum(math.comb(len(bits), x) for x in range(t + 1)) + PAIR_COST * share[t] * total * total / 2 for t in range(distance + 1)])
        budget = distance - m + 1
        table = {0: (0.0, ())}  # sum of (t + 1) so far -> least cost, thresholds
        for c in cost:
            table2: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (sofar, ts) in table.items():
                for t in range(-1, distance + 1):
                    if used + t + 1 <= budget + m and (used + t + 1 not in table2 or sofar + c[t + 1] < table2[used + t + 1][0]):
                        table2[used + t + 1] = (sofar + c[t + 1], (*ts, t))
            table = table2
        total_cost, ts = table[budget + m]
        if best is None or total_cost < best[0]:
            best = (total_cost, Index(tuple(parts), ts))
    return best[1]


def _masks(width: int, threshold: int) -> np.ndarray:
    out, layer = [np.zeros(1, dtype=np.uint64)], {0}
    for _ in range(threshold):
        layer = {x | 1 << b for x in layer for b in range(width) if not x >> b & 1}
        out.append(np.array(sorted(layer), dtype=np.uint64))
    return np.concatenate(out)


def _keys(index: Index):
    """Rows (key, fp, probe): each fingerprint under its own value in every used partition, and probes at the values nearby."""
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64()), ("probe", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [_masks(len(b), t) if t >= 0 else None for b, t in zip(index.parts, index.thresholds)]
        for batch in batches:
            all_fp = batch.column(0).to_numpy()
            for lo in range(0, len(all_fp), 4096):
                fp = all_fp[lo : lo + 4096]
                for k, (bits, mask) in enumerate(zip(index.parts, masks)):
                    if mask is None:
                        continue
                    own = _extract(fp.view(np.uint64), bits) | _U(k << 40)
                    for at in range(0, len(mask), 256):
                        some = mask[at : at + 256]
                        key = (own[:, None] ^ some[None, :]).ravel()
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(some))), pa.array(np.tile(some != 0, len(fp)))], schema=schema)

    return run


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) that connect what the edges (a, b) connect."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        for i in (ia, ib, label[ia], label[ib]):
            np.minimum.at(new, i, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _bucket(fp: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Star edges of the links inside one large bucket: each fingerprint is compared once with those not yet reached."""
    left, a, b = np.unique(fp), [], []
    while len(left) > 1:
        seed, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), dtype=bool)
            for lo in range(0, len(front), 64):
                hit |= (np.bitwise_count(front[lo : lo + 64, None] ^ left[None, :]) <= distance).any(axis=0)
            front, left = left[hit], left[~hit]
            if len(front):
                a.append(front)
                b.append(np.full(len(front), seed))
    return a, b


def _verify(distance: int):
    """Over rows sorted by (key, cell): verified links as forests, a bucket at a time; an unfinished bucket is carried on."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        for s, n in zip(start[size > 48], size[size > 48]):
            x, y = _bucket(fp[s : s + n], distance)
            a += x
            b += y
        start, size = start[(size > 1) & (size <= 48)], size[(size > 1) & (size <= 48)]
        for gap in range(1, int(size.max(initial=1))):
            start, size = start[size > gap], size[size > gap]
            i = tk.ranges(start, size - gap)
            j = i + gap
            ok = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ~(probe[i] & probe[j]) & (fp[i] != fp[j])
            a.append(fp[i[ok]])
            b.append(fp[j[ok]])
        if not a:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return forest(np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            # (key, cell) as one number: cells are few and only hot keys have them
            now = [tk.mix64(batch.column(0).to_numpy().view(np.uint64)) + batch.column(1).to_numpy().astype(np.uint64), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            change = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(change):
                cut = int(change[-1]) + 1
                a, b = links(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)
        if held is not None:
            a, b = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return run


def links(distinct: DataFrame, distance: int = 3, sample: int = SAMPLE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all and only those that links within ``distance`` connect."""
    spark = distinct.sparkSession
    total = distinct.count()
    picked = np.array([r.fp for r in distinct.orderBy(F.xxhash64(F.col("fp"), F.lit(9)), "fp").limit(sample).collect()], dtype=np.int64).view(np.uint64)
    index = fit(picked, total, distance)
    keys = distinct.select("fp").mapInArrow(tk.lean(_keys(index)), "key long, fp long, probe boolean")
    hot = keys.groupBy("key").count().filter(F.col("count") > hot_rows).select("key", F.ceil(F.col("count") / (hot_rows / 2)).cast("long").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # every pair of blocks of a hot key meets in one cell
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    )
    spread = keys.join(hot, "key", "left").select("key", F.explode(cells).alias("cell"), "fp", "probe")
    return spread.repartition(common.tasks(spark), "key", "cell").sortWithinPartitions("key", "cell").mapInArrow(tk.lean(_verify(distance)), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``df``; see the module's notes for defined cases."""
    fps = common.stored(simhash(df, id_col, text_col, width), name="simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    comps = common.components(links(distinct, distance, hot_rows=hot_rows))
    rooted = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """``df`` with one document of each near-duplicate group: the smallest id, and of the rows with that id the first by text.

    Rows with a null id stay only where nothing they link to has an id, one for each text.
    """
    from pyspark.sql import Window

    found = near_duplicates(df, id_col, text_col, width, distance)
    chosen = found.groupBy("component_id").agg(F.min("doc_id").alias("_keep")).filter("_keep is not null").select("_keep").distinct()
    own = F.col(f"`{id_col}`")
    kept = df.filter(own.isNotNull()).join(chosen, own == chosen["_keep"], "left_semi")
    # the join has dealt the rows out by id already
    first = Window.partitionBy(own).orderBy(F.col(f"`{text_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    out = kept.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    if found.filter("component_id is null").limit(1).count():
        lone = found.filter("component_id is null").select("fingerprint").distinct()
        texts = df.filter(own.isNull()).dropDuplicates([text_col])
        out = out.unionByName(texts.join(_texts_with(texts, text_col, width, lone), F.col(f"`{text_col}`").eqNullSafe(F.col("_text")), "left_semi"))
    return out


def _texts_with(df: DataFrame, text_col: str, width: int, lone: DataFrame) -> DataFrame:
    """(_text): the texts whose fingerprint is among ``lone``."""
    numbered = df.select(F.xxhash64(F.col(f"`{text_col}`")).alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    fps = simhash(numbered, "_id", "_text", width).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))
    some = fps.join(lone, "fingerprint", "left_semi")
    return numbered.join(some, numbered["_id"] == some["doc_id"], "left_semi").select("_text")
