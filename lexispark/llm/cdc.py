"""Substring deduplication by content-defined chunking with a gear rolling hash (operator 5).

A gear hash over the last ``WINDOW`` bytes marks cut points at word starts (and, more rarely, at any character, for text
without spaces), no two closer than ``WINDOW`` bytes, so chunks (five to six words on average) depend on content alone and fall
into step again after an insertion. Chunks are deduplicated by a 64-bit digest of a chunk and the one after it: a lone chunk of
a few words recurs by chance in a large corpus, two in a row hardly ever. The occurrence in the smallest id, at the first
position, is the original. A run of consecutive repeats is removed if its chunks have ``run_words`` words (or ``run_bytes``
bytes), so neither short phrases nor single colliding digests cost a text anything; the first occurrence of a chunk always
stays, as a repeat has one before it.

Execution: one scan packs rows with their chunks into blocks in the shared folder; each block sends its distinct digests to
buckets and learns which of them it owns; the blocks then drop their repeats. A digest counts once a block however often it
occurs, so frequent passages stay as cheap as rare ones.

Defined cases: null text stays null; a text of any length is cut and cleaned whole, in one block; empty text stays empty; a text that repeats wholly becomes empty, its row stays; a null
id comes after all others; of rows with one id, the block's first row holds the original; an empty table stays empty; further
columns are carried along (columns named as this operator's own are replaced).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkernel as tk
from .exchange import decode, decode_keys, encode, encode_keys, key_cuts, pack

_U = np.uint64
WINDOW, MOST_BYTES = 16, 512
#: Bits of the gear hash that must be zero at a cut: at word starts, and at other characters.
WORD_MASK, CHAR_MASK = np.uint32(3 << 14), np.uint32(0x7F << 9)
RUN_WORDS, RUN_BYTES = 20, 400
#: Text in one block, and digests that one bucket receives on average, for each GB of memory a core has.
BLOCK_BYTES, BUCKET_ENTRIES = 6 << 20, 2_000_000

_GEAR = (tk.byte_values(77) >> _U(32)).astype(np.uint32)
_ROWS_DDL = "block long, bucket int, payload binary"
_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
OWN = [("n_chunks", pa.int64(), "long"), ("n_dup_chunks", pa.int64(), "long"), ("n_removed_chars", pa.int64(), "long"), ("n_removed_words", pa.int64(), "long"), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "array<struct<start: bigint, end: bigint>>")]


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: sum of (value of the byte j back) << j over ``WINDOW`` bytes, by doubling."""
    h, reach = _GEAR[data], 1
    while reach < WINDOW:
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all chunks, n+1 positions of each text's chunks, and the number of words that start in each chunk."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    h = gear(data)
    starts, _, _ = tk.spans(data, offsets)
    ok = np.zeros(len(data), dtype=bool)
    ok[1:] = ((h[:-1] & CHAR_MASK) == 0) & ((data[1:] & 0xC0) != 0x80)
    inner = starts[starts > 0]
    ok[inner] |= (h[inner - 1] & WORD_MASK) == 0
    cand = np.flatnonzero(ok)
    nxt = np.searchsorted(cand, cand + WINDOW).tolist()
    first = np.searchsorted(cand, offsets[:-1] + WINDOW).tolist()
    cand = cand.tolist()
    out, at, n = [], [0], len(cand)
    for start, end, i in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first):
        if start < end:
            out.append(start)
        last = start
        while i < n and cand[i] < end:
            c = cand[i]
            while c - last > MOST_BYTES:
                last = _boundary(data, last + MOST_BYTES)
                out.append(last)
            if c > last:
                out.append(c)
                last = c
            i = nxt[i]
        while end - last > MOST_BYTES:
            last = _boundary(data, last + MOST_BYTES)
            out.append(last)
        at.append(len(out))
    out = np.array(out, dtype=np.int64)
    return out, np.array(at), np.diff(np.searchsorted(starts, np.append(out, len(data))))


def pairs(digest: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digest of each chunk with the one after it (the digest of a text's only chunk alone), and how many each text has."""
    n = np.diff(at)
    per = np.where(n > 1, n - 1, n)
    first = tk.ranges(at[:-1], per)
    lone = np.repeat(n == 1, per)
    after = digest[np.minimum(first + 1, max(0, len(digest) - 1))] if len(digest) else digest
    with np.errstate(over="ignore"):
        return np.where(lone, digest[first], tk.mix64(digest[first] * _U(0x9E3779B97F4A7C15) + after)), per


def _boundary(data: np.ndarray, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _blocks(id_col: str, text_col: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, part, seq = tk.SpanHash(seed=5, fold_case=False), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
            digest, length, words, per, count = (np.concatenate([x[k] for x in held]) for k in range(1, 6))
            ids = np.array([np.iinfo(np.int64).max if v is None else v for v in rows.column(id_col).cast(pa.int64()).to_pylist()], dtype=np.int64)
            keys, at = np.unique(digest, return_inverse=True)
            of = np.repeat(np.arange(len(per)), per)
            order = np.lexsort((np.arange(len(digest)), ids[of], at))
            head = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])] if len(order) else order
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows)
            block, held, size, seq = part << 32 | seq, [], 0, seq + 1
            payload = pack(rows=sink.getvalue().to_pybytes(), at=encode(at), head=encode(head), length=encode(length), words=encode(words), per=encode(per), count=encode(count))
            asked = pack(keys=keys.tobytes(), ids=(ids[of[head]]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([payload], pa.binary()), pa.array([asked], pa.binary()), pa.array([len(keys)])], names=["block", "payload", "asked", "keys"])

        for batch in batches:
            for rows, data, offsets in tk.slices(batch, text_col):
                starts, at, words = chunks(data, offsets)
                ends = np.append(starts[1:], len(data))
                digest, per = pairs(hasher(data, starts, ends), at)
                held.append((rows, digest, ends - starts, words, per, np.diff(at)))
                size += len(data) + 64 * rows.num_rows
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, asked in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = pickle.loads(asked.as_py())
                keys, ids = np.frombuffer(x["keys"], dtype=np.uint64), np.frombuffer(x["ids"], dtype=np.int64)
                cuts, base = key_cuts(keys, buckets), int(ids.min(initial=0))
                rows = [(block, b, pack(keys=encode_keys(keys[lo:hi]), base=base, ids=encode(ids[lo:hi].view(np.uint64) - np.int64(base).view(np.uint64)))) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                for lo in range(0, len(rows), 64):
                    some = rows[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in some], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)

    return run


def _own(table: pa.Table) -> pa.Table:
    """A bucket: of the blocks that ask for a digest, the one with the smallest id (then the smallest block) owns it."""
    tk.give_back()
    bucket, blocks = table.column("bucket")[0].as_py(), table.column("block").to_pylist()
    keys, ids, sizes = [], [], []
    for p in table.column("payload"):
        x = pickle.loads(p.as_py())
        keys.append(decode_keys(x["keys"]))
        ids.append((decode(x["ids"]).view(np.uint64) + np.int64(x["base"]).view(np.uint64)).view(np.int64))
        sizes.append(len(keys[-1]))
    key, doc = np.concatenate(keys), np.concatenate(ids)
    block = np.repeat(np.argsort(np.argsort(blocks)), sizes)
    order = np.lexsort((block, doc, key))
    owner = np.zeros(len(key), dtype=bool)
    owner[order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]] = True
    cuts = np.cumsum([0, *sizes])
    payload = [pack(owned=encode(owner[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]
    return pa.Table.from_arrays([pa.array(blocks), pa.array([bucket] * len(blocks), pa.int32()), pa.array(payload, pa.binary())], schema=_ROWS)


def _drop(text_col: str, run_words: int, run_bytes: int):
    def run(table: pa.Table) -> pa.Table:
        tk.give_back()
        own = None
        answers = {}
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload")):
            if bucket < 0:
                own = pickle.loads(payload.as_py())
            else:
                answers[bucket] = decode(pickle.loads(payload.as_py())["owned"]).astype(bool)
        rows = pa.ipc.open_stream(own["rows"]).read_all().combine_chunks()
        out = pa.schema([*rows.schema, *[pa.field(n, t) for n, t, _ in OWN]])
        at, head, length, words, per, count = (decode(own[k]) for k in ("at", "head", "length", "words", "per", "count"))
        owned = np.concatenate([answers[b] for b in sorted(answers)]) if answers else np.zeros(0, dtype=bool)
        repeat = np.ones(len(at), dtype=bool)
        repeat[head[owned]] = False
        pair_cuts, cuts = (np.concatenate([[0], np.cumsum(x)]) for x in (per, count))
        # the chunks from begin to end of each run of repeated pairs inside a text
        chunk = np.arange(len(at)) + np.repeat(cuts[:-1] - pair_cuts[:-1], per)
        edge = np.zeros(len(at) + 1, dtype=bool)
        edge[pair_cuts] = True
        follows = np.concatenate([[False], repeat[:-1]]) & ~edge[:-1]
        goes_on = np.concatenate([repeat[1:], [False]]) & ~edge[1:]
        begin, end = chunk[repeat & ~follows], chunk[repeat & ~goes_on]
        end = end + np.where(np.repeat(count > 1, per)[repeat & ~goes_on], 2, 1)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        w, b = total(words), total(length)
        long = (w[end] - w[begin] >= run_words) | (b[end] - b[begin] >= run_bytes)
        mark = np.zeros(len(length) + 1, dtype=np.int64)
        np.add.at(mark, begin[long], 1)
        np.add.at(mark, end[long], -1)
        gone = np.cumsum(mark[:-1]) > 0
        np.add.at(dup := np.zeros(len(length) + 1, dtype=np.int64), begin, 1)
        np.add.at(dup, end, -1)
        repeated = np.cumsum(dup[:-1]) > 0
        data, offsets = tk.buffers(rows.column(text_col))
        start = np.concatenate([[0], np.cumsum(length)])
        text = rows.column(text_col).to_pylist()
        spans: list[list] = [[] for _ in text]
        n_chars = np.zeros(len(text), dtype=np.int64)
        for d in np.unique(np.searchsorted(cuts, np.flatnonzero(gone), "right") - 1):
            lo, hi = cuts[d], cuts[d + 1]
            mask = np.repeat(gone[lo:hi], length[lo:hi])
            raw = data[offsets[d] : offsets[d + 1]]
            char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            step = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            spans[d] = [{"start": int(char[a]), "end": int(char[b])} for a, b in step.reshape(-1, 2)]
            n_chars[d] = sum(s["end"] - s["start"] for s in spans[d])
            text[d] = raw[~mask].tobytes().decode()
        new = {text_col: text, "n_chunks": count, "n_dup_chunks": tk.sums(repeated, cuts), "n_removed_chars": n_chars, "n_removed_words": tk.sums(np.where(gone, words, 0), cuts), "removed": spans}
        return pa.Table.from_arrays([pa.array(new[f.name], f.type) if f.name in new else rows.column(f.name).cast(f.type) for f in out], schema=out)

    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, run_bytes: int = RUN_BYTES, block_bytes: int | None = None, bucket_entries: int | None = None) -> DataFrame:
    """``df`` with repeated passages removed from the text, and n_chunks, n_dup_chunks, n_removed_chars, n_removed_words and
    removed (the removed [start, end) ranges in characters of the input text)."""
    spark = df.sparkSession
    common.short_batches(spark)
    block_bytes = block_bytes or int(BLOCK_BYTES * common.room(spark))
    bucket_entries = bucket_entries or int(BUCKET_ENTRIES * common.room(spark))
    own = {n for n, _, _ in OWN}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in own])
    blocks = common.stored(df.mapInArrow(tk.lean(_blocks(id_col, text_col, block_bytes)), "block long, payload binary, asked binary, keys long"), name="cdc-blocks")
    buckets = max(common.tasks(spark), -(-(blocks.agg(F.sum("keys")).first()[0] or 0) // bucket_entries))
    answers = blocks.select("block", "asked").mapInArrow(tk.lean(_ask(buckets)), _ROWS_DDL).groupBy("bucket").applyInArrow(_own, _ROWS_DDL)
    both = blocks.select("block", F.lit(-1).alias("bucket"), "payload").unionByName(answers)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema] + T._parse_datatype_string(", ".join(f"{n} {t}" for n, _, t in OWN)).fields)
    return both.groupBy("block").applyInArrow(_drop(text_col, run_words, run_bytes), schema)


def cleaned(df: DataFrame, **options) -> DataFrame:
    """``df`` with repeated passages removed from the text; its columns are else unchanged."""
    return common.around(df, [n for n, _, _ in OWN], lambda d: dedup_substrings(d, **options))
