"""One document of each near-duplicate group, by operator 9's fingerprints and search (the pipeline's near_dedup stage).

Two texts link when the Jaccard similarity of their sets of five-word shingles (lower-cased, a text of fewer words is one
shingle) is 0.8 or more. Groups are the connected components of the links.

Search: every text has a SimHash fingerprint of ``WORDS`` times 64 bits over its two-word shingles (a changed word touches two
of these but five of the long ones, so similar texts stay close). Texts of which one 64-bit word differs in ``DISTANCE`` bits or
fewer are candidates; by the pigeonhole principle these include all that differ in at most WORDS * (DISTANCE + 1) - 1 bits, and
each word is searched by operator 9's generalised pigeonhole (correlated bits grouped, thresholds by dynamic programming on
estimated candidate counts). Buckets leave their tasks as spanning forests. The first words are searched first; the others then
only link what these left apart, so a large group of near copies does not give its links once for every word. The components
of these coarse links are verified pair by pair on exact sets of 64-bit shingle hashes, each text moved once: only texts not
yet linked are compared, and links leave tasks as spanning forests. Large buckets and coarse groups are cut into blocks, and
every pair of blocks meets in one cell. Texts of equal shingles are one node. The only pairs missed are those that no coarse
link connects; the README gives the share by similarity.

Defined cases: null text counts as empty; texts without words are one node; a null id keeps its row and links; repeated rows
and further columns are allowed; a text of any length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, simhash
from . import textkernel as tk
from .simhash import forest

_U = np.uint64
WIDTH = 5
#: Links need 10 * |a & b| >= 8 * |a | b|.
SIMILAR, OF = 8, 10
#: Words of 64 bits of a fingerprint, over shingles of so many words; bits in which a word of candidates differs at most.
WORDS, PRINT_WIDTH, DISTANCE = 16, 2, 4
#: Words that are searched first, partitions of a word at most, rows under one key that are one task's work.
FIRST, MOST_PARTS, HOT_ROWS = 2, 5, 32_768
#: Links that a task holds before it reduces them to a forest.
MOST_LINKS = 1_000_000
#: Texts and shingles of one block of a coarse group.
BLOCK_TEXTS, BLOCK_SHINGLES = 1000, 1_000_000

_HASH = tk.SpanHash(5)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text in order (repeats included), and n+1 positions of each text's."""
    with np.errstate(over="ignore"):
        words, at = tk.token_hashes(data, offsets, _HASH)
        n = np.diff(at)
        count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
        first = tk.ranges(np.asarray(at[:-1]), count)
        end = np.repeat(at[1:], count)
        h = np.zeros(len(first), dtype=np.uint64)
        for k in range(width):
            there = first + k < end
            h[there] = tk.mix64(h[there] * _U(0xD6E8FEB86659FD93) + words[first[there] + k] + _U(k + 1))
    return h, np.concatenate([[0], np.cumsum(count)])


def nodes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A number for each text's shingles with their counts; texts without words have 0."""
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(tk.mix64(h ^ _U(0x5851F42D4C957F2D)), out=total[1:])
        return tk.mix64(total[at[1:]] - total[at[:-1]])


def prints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(WORDS, texts): the words of each text's fingerprint."""
    h, at = shingles(data, offsets, PRINT_WIDTH)
    with np.errstate(over="ignore"):
        return np.stack([simhash.majority(tk.mix64(h + _U(k) * _U(0x9E3779B97F4A7C15)), np.diff(at)) for k in range(1, WORDS + 1)])


_NUMBERED = "doc_id long, node long, n long, fps array<long>"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, node, n, fps)."""
    for batch in batches:
        for rows, data, offsets in tk.slices(batch, "text"):
            h, at = shingles(data, offsets)
            fps = np.ascontiguousarray(prints(data, offsets).T).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, WORDS, dtype=np.int32)), pa.array(fps))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(nodes(h, at).view(np.int64)), pa.array(np.diff(at)), lists], names=["doc_id", "node", "n", "fps"])


def _nodes_too(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, text)."""
    for batch in batches:
        for rows, data, offsets in tk.slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(nodes(*shingles(data, offsets)).view(np.int64)), rows.column("text").cast(pa.string())], names=["node", "text"])


def _linked(node: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that connect what the similar pairs among these texts connect; each text is compared with those not yet reached."""
    size = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bound = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(len(ids), dtype=bool)
    left, a, b = np.arange(len(sets)), [], []
    at, items = bound[:-1], flat
    while len(left) > 1:
        seed, front = left[0], [left[0]]
        left, at, items = left[1:], at[1:] - size[left[0]], items[size[left[0]] :]
        while front and len(left):
            one = front.pop()
            own = flat[bound[one] : bound[one + 1]]
            mark[own] = True
            both = np.add.reduceat(mark[items], at, dtype=np.int64)
            mark[own] = False
            hit = OF * both >= SIMILAR * (size[left] + size[one] - both)
            if hit.any():
                front.extend(left[hit])
                a.append(node[left[hit]])
                b.append(np.full(int(hit.sum()), node[seed]))
                items = items[np.repeat(~hit, size[left])]
                left = left[~hit]
                at = np.concatenate([[0], np.cumsum(size[left])[:-1]]) if len(left) else at[:0]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (root, cell, node, text) sorted by (root, cell): the verified links of each cell."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    now, node, sets = None, [], []

    def done():
        a, b = _linked(np.array(node, dtype=np.int64), sets) if len(node) > 1 else (np.zeros(0, np.int64),) * 2
        if len(a):
            a, b = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    for batch in batches:
        for rows, data, offsets in tk.slices(batch, "text"):
            h, at = shingles(data, offsets)
            for k, (root, cell, n) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("root", "cell", "node")))):
                if (root, cell) != now:
                    if now is not None:
                        yield done()
                    now, node, sets = (root, cell), [], []
                node.append(n)
                sets.append(np.unique(h[at[k] : at[k + 1]]))
    if now is not None:
        yield done()


class _Keys:
    """The keys of fingerprints: each word under its own value in every used partition and, where a threshold asks, at the values
    nearby (probes)."""

    def __init__(self, index: simhash.Index, words: range):
        self.parts = [(k, bits, simhash._masks(len(bits), t)) for k, (bits, t) in enumerate(zip(index.parts, index.thresholds)) if t >= 0]
        self.words = words
        self.per_row = len(words) * sum(len(mask) for _, _, mask in self.parts)
        self.probes = any(len(mask) > 1 for _, _, mask in self.parts)

    def of(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word's fingerprints, keys (rows, values), values that are probes)."""
        for w in self.words:
            fp = np.ascontiguousarray(fps[:, w])
            for k, bits, mask in self.parts:
                own = simhash._extract(fp.view(np.uint64), bits) | _U(k << 40) | _U(w << 48)
                for at in range(0, len(mask), 256):
                    near = mask[at : at + 256]
                    yield fp, (own[:, None] ^ near[None, :]).view(np.int64), near != 0


def _keyed(keys: _Keys):
    """Rows (key, fp, node) of rows (node, fps), with ``probe`` where there are any."""
    names = ["key", "fp", "node", *["probe"] * keys.probes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                node = some.column("node").to_numpy()
                for fp, key, probe in keys.of(some.column("fps").flatten().to_numpy().reshape(len(node), WORDS)):
                    more = [pa.array(np.tile(probe, len(fp)))] if keys.probes else []
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(fp, len(probe))), pa.array(np.repeat(node, len(probe))), *more], names=names)

    return run


def _frequent(keys: _Keys, rows: int, least: int):
    """Rows (key, n) of rows (fps): in each run of ``rows`` of them the keys that ``least`` or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            found = np.concatenate([key.ravel() for _, key, _ in keys.of(np.concatenate(held))])
            key, n = np.unique(found, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least]), pa.array(n[n >= least])], names=["key", "n"])

        for batch in batches:
            held.append(batch.column("fps").flatten().to_numpy().reshape(batch.num_rows, WORDS))
            size += batch.num_rows
            if size >= rows:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return run


def _bucket_links(fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[list, list]:
    """Star edges of one large bucket: equal fingerprints at once, the others each compared with those not yet reached."""
    order = np.lexsort((node, fp))
    fp, node = fp[order], node[order]
    new = np.concatenate([[True], fp[1:] != fp[:-1]])
    head = node[new]
    a, b = [node[~new]], [head[np.cumsum(new) - 1][~new]]
    x, y = simhash._bucket(fp, distance)
    if x:
        some = fp[new]
        a.append(head[np.searchsorted(some, np.concatenate(x))])
        b.append(head[np.searchsorted(some, np.concatenate(y))])
    return a, b


def _joined(distance: int):
    """Over rows (key, fp, node) sorted by key: links (a, b) between the nodes of candidates, as forests over many buckets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key: np.ndarray, fp: np.ndarray, node: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([start, [len(key)]]))
        for s, n in zip(start[size > 48], size[size > 48]):
            if (node[s : s + n] != node[s]).any():
                x, y = _bucket_links(fp[s : s + n], node[s : s + n], distance)
                a += x
                b += y
        start, size = start[(size > 1) & (size <= 48)], size[(size > 1) & (size <= 48)]
        for gap in range(1, int(size.max(initial=1))):
            start, size = start[size > gap], size[size > gap]
            i = tk.ranges(start, size - gap)
            j = i + gap
            ok = (np.bitwise_count(fp[i] ^ fp[j]) <= distance) & ~(probe[i] & probe[j]) & (node[i] != node[j])
            a.append(node[i[ok]])
            b.append(node[j[ok]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return forest(a, b) if len(a) else (a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def reduced():
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            out.clear()
            return forest(a, b) if len(a) else (a, b)

        for batch in batches:
            probe = batch.column(3).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else np.zeros(batch.num_rows, dtype=bool)
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(), probe]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            change = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(change):
                cut = int(change[-1]) + 1
                out.append(links(*(x[:cut] for x in held)))
                held = [x[cut:] for x in held]
                if sum(len(a) for a, _ in out) > MOST_LINKS:
                    a, b = reduced()
                    if len(a) > MOST_LINKS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                    else:
                        out.append((a, b))
        if held is not None:
            out.append(links(*held))
        a, b = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return run


#: Keys that are counted at once.
RUN_KEYS = 1_000_000


def _search(rows: DataFrame, total: int, words: range, index: simhash.Index, distance: int, hot_rows: int) -> DataFrame:
    """Distinct edges (a, b) between the nodes of rows (node, fps), ``total`` of them, that some of the words make candidates."""
    spark, keys = rows.sparkSession, _Keys(index, words)
    run = max(1, RUN_KEYS // keys.per_row)
    runs = -(-total // run) + common.tasks(spark)
    # what runs leave out of a key's count is less than runs * least, half of what makes it hot
    least = max(1, hot_rows // 2 // runs)
    counts = rows.select("fps").mapInArrow(tk.lean(_frequent(keys, run, least)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = counts.filter(F.col("n") > hot_rows // 2).select("key", F.ceil((F.col("n") + hot_rows / 2) / (hot_rows / 2)).cast("long").alias("blocks"))
    keyed = rows.select("node", "fps").mapInArrow(tk.lean(_keyed(keys)), "key long, fp long, node long" + ", probe boolean" * keys.probes)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    # every pair of blocks of a hot key meets in one cell, under a key of its own
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(own, j) * F.col("blocks") + F.greatest(own, j)))
    spread = keyed.join(hot, "key", "left").select(F.explode(F.coalesce(cells, F.array("key"))).alias("key"), "fp", "node", *["probe"] * keys.probes)
    return spread.repartition(common.tasks(spark), "key").sortWithinPartitions("key").mapInArrow(tk.lean(_joined(distance)), "a long, b long").distinct()


def coarse_groups(numbered: DataFrame, distance: int = DISTANCE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, root) of the nodes with words that candidates connect with others."""
    some = numbered.filter("n > 0").select("node", "fps").dropDuplicates(["node"])
    total = some.count()
    picked = np.array([r.fp for r in some.select(F.col("fps")[0].alias("fp"), "node").orderBy(F.xxhash64("node", F.lit(9)), "node").limit(simhash.SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    index = simhash.fit(picked, total, distance, MOST_PARTS)
    first = common.stored(common.components(_search(some, total, range(FIRST), index, distance, hot_rows)), name="first")
    rooted = some.join(first, "node", "left").select(F.coalesce("root", "node").alias("node"), "fps")
    rest = _search(rooted, total, range(FIRST, WORDS), index, distance, hot_rows)
    return common.components(rest.unionByName(first.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))


def links(texts: DataFrame, numbered: DataFrame, block_texts: int = BLOCK_TEXTS, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between nodes from rows (doc_id, text) and (doc_id, node, n, fps): they connect what the similar pairs
    among the candidates connect."""
    spark = texts.sparkSession
    coarse = common.stored(coarse_groups(numbered, distance), name="coarse")
    # of equal nodes one text moves, and only of nodes with candidates
    sizes = numbered.groupBy("node").agg(F.first("n").alias("n")).join(coarse, "node")
    once = texts.mapInArrow(tk.lean(_nodes_too), "node long, text string").join(coarse.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    some = common.stored(once.join(sizes, "node"), name="candidates")
    blocks = some.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(own, j) * F.col("blocks") + F.greatest(own, j))
    )
    spread = some.join(blocks, "root", "left").select("root", F.explode(cells).alias("cell"), "node", "text")
    return spread.repartition(common.tasks(spark), "root", "cell").sortWithinPartitions("root", "cell").mapInArrow(tk.lean(_verify), "a long, b long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_texts: int = BLOCK_TEXTS, distance: int = DISTANCE) -> DataFrame:
    """``df`` with one document of each near-duplicate group: the smallest id, and of the rows with that id the first by text.

    Of a group without any id the first text stays.
    """
    spark = df.sparkSession
    common.short_batches(spark)
    texts = common.renamed(df, {id_col: "doc_id", text_col: "text"}).select(F.col("doc_id").cast("long"), "text")
    with common.scratch(spark) as keep:
        found = common.stored(texts.mapInArrow(tk.lean(_numbered), _NUMBERED), name="nodes")
        comps = common.stored(common.components(links(texts, found, block_texts, distance)), name="components")
        least = found.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        rooted = keep(common.stored(least.join(comps, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), name="rooted"))
        again = keep(common.stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_again")), name="again"))
    groups = rooted.groupBy("root").agg(F.min("doc_id").alias("_keep"))
    own = F.col(f"`{id_col}`")
    chosen = groups.filter("_keep is not null").select("_keep")
    out = df.filter(own.isNotNull()).join(chosen, own == chosen["_keep"], "left_semi")
    if again.limit(1).count():
        # only rows of ids that several have are compared
        first = Window.partitionBy(own).orderBy(F.col(f"`{text_col}`"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        several = out.join(again, own == again["_again"], "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
        out = out.join(again, own == again["_again"], "left_anti").unionByName(several)
    lone = groups.filter("_keep is null").select("root")
    if lone.limit(1).count():
        named = rooted.join(lone, "root").select("node", "root")
        nameless = texts.filter("doc_id is null").select("text").mapInArrow(tk.lean(_nodes_too), "node long, text string")
        without = nameless.join(named, "node").groupBy("root").agg(F.min("text").alias("_text")).select("_text")
        rows = df.filter(own.isNull()).dropDuplicates([text_col])
        out = out.unionByName(rows.join(without, F.col(f"`{text_col}`").eqNullSafe(F.col("_text")), "left_semi"))
    return out
