"""Katz backoff language model (operator 2): Good-Turing discounted n-gram counts with exactly normalised backoff weights.

Model. Tokens are white-space words with A-Z lower-cased, then one end token a text; a begin mark starts the histories. Level
1 gives every known word d_r * r / N and the unknown-word class what discounting frees. Level m gives a seen (history, word)
d_r * r / C(history), and otherwise alpha(history) times level m - 1, where alpha is the freed mass of the history divided by
the mass that level m - 1 leaves to words not seen after it; an unseen history passes on to level m - 1 unchanged. Hence the
probabilities of all known words and the unknown class sum to one after every history. Discounts are Katz's for counts up to
``CUTOFF``; where the counts of counts make one invalid, that level takes (r - D) / r with D = max(0.1, n1 / (n1 + 2 n2)). A
history (or the whole of level 1) without a count up to the cutoff gets one count more in its denominator, which is freed.

Execution. One scan packs the texts into blocks of token numbers (a dictionary of 64-bit word hashes each) in the shared
folder. Each level is one exchange: a block sends its distinct n-grams, counted, to the buckets their keys hash to; a bucket
adds up the counts of all blocks, keeps them as its part of the level's table, and answers every block in the order asked.
Nothing is sent a token at a time, buckets hold a bounded number of n-grams, and histories too frequent for one bucket are
salted over several, with their (few, bounded) sums added up afterwards. Scores then follow the recursion inside each block.

Defined cases: null text is empty and has the end token only; a text of any length is scored whole, in one block; null ids and repeated rows keep their rows (a null id counts as
held out); an empty training set leaves all probability to the unknown class; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkernel as tk
from .exchange import decode, decode_floats, encode, encode_floats, key_cuts, pack

_U = np.uint64
CUTOFF = 5
#: Text in one block, and n-gram entries that one bucket receives on average, for each GB of memory a core has.
BLOCK_BYTES, BUCKET_ENTRIES = 6 << 20, 1_000_000
#: A history with more training tokens than this is salted, one bucket for each half of it; at most MOST_HOT histories are.
HOT_TOKENS, MOST_HOT = 400_000, 65_536
END, BEGIN, UNKNOWN = _U(0x0E0D), 1, 0
FIRST_ID = 2

_ROWS = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
_ROWS_DDL = "chunk long, level int, bucket int, payload binary"
_OUT = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary()), ("hid", pa.int64()), ("total", pa.int64()), ("low", pa.float64()), *[(f"n{r}", pa.int64()) for r in range(1, CUTOFF + 2)]])
_OUT_DDL = f"kind string, chunk long, level int, bucket int, payload binary, hid long, total long, low double, {', '.join(f'n{r} long' for r in range(1, CUTOFF + 2))}"


@dataclass
class Level:
    """What all blocks need to know of a level: counts of counts, tokens, and the sums of salted histories."""

    n: np.ndarray  # counts of counts 1 .. CUTOFF + 1
    total: int
    types: int
    buckets: int
    hot: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def discounts(self) -> np.ndarray:
        """d_0 .. d_CUTOFF (d_0 = 0)."""
        return discounts(self.n)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's discount for each count up to the cutoff, from n[0] = n_1, ..., n[CUTOFF] = n_{CUTOFF+1}."""
    n = np.asarray(n, dtype=np.float64)
    r = np.arange(1, CUTOFF + 1)
    with np.errstate(all="ignore"):
        lost = (CUTOFF + 1) * n[CUTOFF] / n[0]
        d = ((r + 1) * n[1:] / n[:-1] / r - lost) / (1 - lost)
    if not (np.isfinite(d).all() and (d > 0).all() and (d < 1).all()):
        cut = max(0.1, n[0] / (n[0] + 2 * n[1])) if n[0] else 0.1
        d = (r - min(cut, 0.9)) / r
    return np.concatenate([[0.0], d])


def freed(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Count mass that discounting frees, given how many words have each count 1 .. CUTOFF (last axis)."""
    r = np.arange(1, CUTOFF + 1)
    return (n[..., :CUTOFF] * ((1 - d[1:]) * r)).sum(axis=-1)


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(count <= CUTOFF, d[np.minimum(count, CUTOFF)], 1.0) * count


def unigram(count: np.ndarray, level: Level) -> np.ndarray:
    """Probability of known words by count, and of the unknown class where the count is 0."""
    d = level.discounts
    mass = float(freed(level.n, d))
    total = level.total if mass > 0 else level.total + 1
    mass = mass if mass > 0 else 1.0
    return np.where(count > 0, discounted(count, d), mass) / total


def _blocks(block_bytes: int):
    """Packs (doc_id, text, train) rows into blocks; see ``_Block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hasher, part, seq = tk.SpanHash(), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, seq
            h, lengths, ids, train = (np.concatenate([x[k] for x in held]) for k in range(4))
            words, at, n = np.unique(h, return_inverse=True, return_counts=True)
            rank = np.argsort(-n, kind="stable")
            of_rank = np.empty(len(rank), dtype=np.int64)
            of_rank[rank] = np.arange(len(rank))
            count = np.bincount(at[np.repeat(train, lengths)], minlength=len(words))
            known = ids != None  # noqa: E711
            payload = pack(tokens=encode(of_rank[at]), order=encode(rank), lengths=encode(lengths), known=encode(known), ids=np.where(known, ids, 0).astype(np.int64).tobytes(), train=encode(train))
            first = pack(words=words.tobytes(), counts=encode(count))
            chunk = part << 32 | seq
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([payload], pa.binary()), pa.array([first], pa.binary()), pa.array([len(h)]), pa.array([int(count.sum())])], names=["chunk", "payload", "first", "tokens", "trained"])

        for batch in batches:
            for rows, data, offsets in tk.slices(batch, "text"):
                h, at = tk.token_hashes(data, offsets, hasher)
                lengths = np.diff(at) + 1
                h = np.insert(h, at[1:], END)
                held.append((h, lengths, np.array(rows.column("doc_id").to_pylist(), dtype=object), rows.column("train").to_numpy(zero_copy_only=False).astype(bool)))
                size += len(data) + 8 * len(lengths)
                if size >= block_bytes:
                    yield flush()
        if held:
            yield flush()

    return run


class _Block:
    """A block's tokens and, level by level, what the buckets answered."""

    def __init__(self, payload: bytes):
        x = pickle.loads(payload)
        self.tokens = decode(x["order"])[decode(x["tokens"])]  # position in the block's sorted dictionary
        self.lengths = decode(x["lengths"])
        self.ids, self.known, self.train = np.frombuffer(x["ids"], dtype=np.int64), decode(x["known"]).astype(bool), decode(x["train"]).astype(bool)
        self.first = np.zeros(len(self.tokens), dtype=bool)
        self.at = np.concatenate([[0], np.cumsum(self.lengths)])
        self.first[self.at[:-1]] = True
        self.token_train = np.repeat(self.train, self.lengths)

    def words(self, answers: list[dict], level: Level) -> None:
        """Level 1: answers hold the dictionary's runs in bucket order."""
        ids, counts = (np.concatenate([decode(a[k]) for a in answers]) if answers else np.zeros(0, np.int64) for k in ("ids", "counts"))
        self.word, self.count = ids[self.tokens], counts[self.tokens]
        self.p = unigram(self.count, level)
        self.gram, self.gram_count = self.word, self.count

    def request(self, level_below: Level, buckets: int, level: int):
        """Distinct (history, word) pairs of the next level with their bucket, and each asking position's pair."""
        history = np.concatenate([[0], self.gram[:-1]])
        weight = np.concatenate([[0], self.gram_count[:-1]])
        history[self.first] = BEGIN if level == 2 else 0
        weight[self.first] = level_below.total  # as frequent as can be
        self.asking = np.flatnonzero(history > 0)
        hid, wid = history[self.asking], self.word[self.asking]
        hs, h = np.unique(hid, return_inverse=True)
        ws, w = np.unique(wid, return_inverse=True)
        pairs, self.pair, count = np.unique(h * len(ws) + w, return_inverse=True, return_counts=True)
        some = np.zeros(len(pairs), dtype=np.int64)
        some[self.pair] = self.asking
        trained = np.bincount(self.pair[self.token_train[self.asking]], minlength=len(pairs))
        hid, wid = hs[pairs // max(1, len(ws))], ws[pairs % max(1, len(ws))]
        hot = max(HOT_TOKENS, level_below.total // MOST_HOT)
        salts = np.where(weight[some] > hot, -(-weight[some] * 2 // hot), 1)
        salts = np.minimum(salts, buckets)
        salt = tk.mix64(wid.astype(np.uint64)) % salts.astype(np.uint64)
        bucket = ((tk.mix64(hid.astype(np.uint64) * _U(0x9E3779B97F4A7C15)) + salt) % _U(buckets)).astype(np.int64)
        self.order = np.lexsort((np.arange(len(pairs)), bucket))
        self.hid, self.wid, self.trained, self.low, self.salts, self.bucket = (x[self.order] for x in (hid, wid, trained, self.p[some], salts, bucket))
        self.cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))

    def take(self, answers: dict[int, dict], level: Level) -> None:
        """Turns a level's answers into probabilities, and into the grams of the next level."""
        n = len(self.hid)
        count, gram, alpha, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n), np.ones(n)
        d = level.discounts
        for b, a in answers.items():
            lo, hi = self.cuts[b], self.cuts[b + 1]
            count[lo:hi] = decode(a["count"])
            if "gram" in a:
                gram[lo:hi] = decode(a["gram"])
            hid = self.hid[lo:hi]
            new = np.concatenate([[True], hid[1:] != hid[:-1]])
            hs, which = hid[new], np.cumsum(new) - 1
            sums = np.stack([decode(x) for x in a["sums"]], axis=1)
            low = np.frombuffer(a["low"], dtype=np.float64).copy()
            if len(level.hot.get("hid", ())):
                i = np.searchsorted(level.hot["hid"], hs)
                i[i == len(level.hot["hid"])] = 0
                is_hot = level.hot["hid"][i] == hs
                sums[is_hot] = level.hot["sums"][i[is_hot]]
                low[is_hot] = level.hot["low"][i[is_hot]]
            mass, c = freed(sums[:, 1:], d), sums[:, 0].astype(np.float64)
            full = (mass <= 0) & (c > 0)
            mass, c = np.where(full, 1.0, mass), np.where(full, c + 1, c)
            with np.errstate(all="ignore"):
                weight = np.where(c > 0, mass / c / (1 - low), 1.0)
            alpha[lo:hi], total[lo:hi] = weight[which], np.where(c > 0, c, 1)[which]
        r = count[self.pair_at()]
        i = self.pair_at()
        p = self.p.copy()
        p[self.asking] = np.where(r > 0, discounted(r, d) / total[i], alpha[i] * self.p[self.asking])
        self.p = p
        self.gram, self.gram_count = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        self.gram[self.asking], self.gram_count[self.asking] = gram[i], r

    def pair_at(self) -> np.ndarray:
        back = np.empty(len(self.order), dtype=np.int64)
        back[self.order] = np.arange(len(self.order))
        return back[self.pair]


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, first in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = pickle.loads(first.as_py())
                words, counts = np.frombuffer(x["words"], dtype=np.uint64), decode(x["counts"])
                cuts = key_cuts(words, buckets)
                cells = [(b, pack(words=words[lo:hi].tobytes(), counts=encode(counts[lo:hi]))) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                for lo in range(0, len(cells), 64):
                    some = cells[lo : lo + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(some)), pa.array([1] * len(some), pa.int32()), pa.array([b for b, _ in some], pa.int32()), pa.array([p for _, p in some], pa.binary())], schema=_ROWS)

    return run


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_OUT)], schema=_OUT)


def _stat(bucket: int, count: np.ndarray, level: int) -> tuple:
    n = np.bincount(np.minimum(count, CUTOFF + 2), minlength=CUTOFF + 3)
    return ("stats", 0, level, bucket, None, int((count > 0).sum()), int(count.sum()), 0.0, *map(int, n[1 : CUTOFF + 2]))


_NONE = (None, None, None, *[None] * (CUTOFF + 1))


def _add_words(buckets: int):
    """A bucket of level 1: totals, numbers for known words (the frequent first), an answer to each block."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        asked = [(c, x["words"], x["counts"]) for c, p in zip(table.column("chunk").to_pylist(), table.column("payload")) if (x := pickle.loads(p.as_py()))]
        words = [np.frombuffer(w, dtype=np.uint64) for _, w, _ in asked]
        all_words, at = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([decode(c) for _, _, c in asked]).astype(np.float64), minlength=len(all_words)).astype(np.int64)
        ids = np.empty(len(all_words), dtype=np.int64)
        ids[np.argsort(-count, kind="stable")] = FIRST_ID + np.arange(len(all_words)) * buckets + bucket
        ids[count == 0] = UNKNOWN
        out, lo = [_stat(bucket, count, 1)], 0
        seen = count > 0
        out.append(("model", -1, 1, bucket, pack(words=all_words[seen].tobytes(), ids=encode(ids[seen]), counts=encode(count[seen])), *_NONE))
        for (chunk, _, _), w in zip(asked, words):
            i = at[lo : lo + len(w)]
            lo += len(w)
            out.append(("answer", chunk, 1, bucket, pack(ids=encode(ids[i]), counts=encode(count[i])), *_NONE))
        return _rows(out)

    return run


def _block_of(table: pa.Table, levels: list[Level]) -> tuple[int, _Block]:
    """Rebuilds a block from its row and the answers so far."""
    tk.give_back()
    by: dict[int, dict[int, bytes]] = {}
    for level, bucket, payload in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("payload")):
        by.setdefault(level, {})[bucket] = payload.as_py()
    block = _Block(by[0][0])
    for m, level in enumerate(levels, 1):
        answers = {b: pickle.loads(p) for b, p in sorted(by.get(m, {}).items())}
        if m == 1:
            block.words(list(answers.values()), level)
        else:
            block.request(levels[m - 2], level.buckets, m)
            block.take(answers, level)
    return table.column("chunk")[0].as_py(), block


def _ask(levels: list[Level], buckets: int):
    level = len(levels) + 1

    def run(table: pa.Table) -> pa.Table:
        chunk, block = _block_of(table, levels)
        block.request(levels[-1], buckets, level)
        rows = []
        for b in range(buckets):
            lo, hi = block.cuts[b], block.cuts[b + 1]
            if hi > lo:
                hid = block.hid[lo:hi]
                payload = pack(hid=encode(np.diff(hid, prepend=0)), wid=encode(block.wid[lo:hi]), count=encode(block.trained[lo:hi]), low=encode_floats(block.low[lo:hi]), salts=encode(block.salts[lo:hi]))
                rows.append((chunk, level, b, payload))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ROWS)], schema=_ROWS)

    return run


def _add(buckets: int, last: bool):
    """A bucket of a level from 2: totals of its n-grams, sums of its histories, an answer to each block."""

    def run(table: pa.Table) -> pa.Table:
        tk.give_back()
        bucket, level = table.column("bucket")[0].as_py(), table.column("level")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        asked = [pickle.loads(p.as_py()) for p in table.column("payload")]
        hids, sizes = [np.cumsum(decode(x["hid"])) for x in asked], []
        sizes = np.array([len(h) for h in hids])
        hid = np.concatenate(hids)
        del hids
        hs, h = np.unique(hid, return_inverse=True)
        wid = np.concatenate([decode(x["wid"]) for x in asked])
        # the words of a bucket are far fewer than 2^40
        key, at = np.unique((h << 40) | wid, return_inverse=True)
        del h
        count = np.bincount(at, weights=np.concatenate([decode(x["count"]) for x in asked]).astype(np.float64), minlength=len(key)).astype(np.int64)
        low = np.zeros(len(key))
        low[at] = np.concatenate([decode_floats(x["low"]) for x in asked])
        salted = np.zeros(len(hs), dtype=bool)
        salted[np.searchsorted(hs, hid[np.concatenate([decode(x["salts"]) for x in asked]) > 1])] = True
        of = key >> 40
        gram = np.where(count > 0, FIRST_ID + np.arange(len(key)) * buckets + bucket, 0)
        n_h = len(hs)
        sums = np.stack([np.bincount(of, weights=count.astype(np.float64), minlength=n_h), *[np.bincount(of[count == r], minlength=n_h) for r in range(1, CUTOFF + 1)]], axis=1).astype(np.int64)
        lows = np.bincount(of, weights=np.where(count > 0, low, 0.0), minlength=n_h)
        out = [_stat(bucket, count, level)]
        seen = count > 0
        model = dict(hid=encode(np.diff(hs[of[seen]], prepend=0)), wid=encode((key & ((1 << 40) - 1))[seen]), count=encode(count[seen]))
        out.append(("model", -1, level, bucket, pack(**model), *_NONE))
        for i in np.flatnonzero(salted):
            out.append(("hot", 0, level, bucket, None, int(hs[i]), int(sums[i, 0]), float(lows[i]), *map(int, sums[i, 1:]), 0))
        lo = 0
        for chunk, size in zip(chunks, sizes):
            own, i = hid[lo : lo + size], at[lo : lo + size]
            lo += size
            j = np.searchsorted(hs, own[np.concatenate([[True], own[1:] != own[:-1]])])
            payload = dict(count=encode(count[i]), sums=[encode(sums[j, k]) for k in range(CUTOFF + 1)], low=lows[j].tobytes())
            if not last:
                payload["gram"] = encode(gram[i])
            out.append(("answer", chunk, level, bucket, pack(**payload), *_NONE))
        return _rows(out)

    return run


def _summary(table: DataFrame, buckets: int) -> Level:
    """Statistics that all blocks need: one row, and the salted histories (at most MOST_HOT by the threshold)."""
    sums = [F.sum(f"n{r}").alias(f"n{r}") for r in range(1, CUTOFF + 2)]
    one = table.filter("kind = 'stats'").agg(F.sum("total").alias("total"), F.sum("hid").alias("types"), *sums).first()
    level = Level(np.array([one[f"n{r}"] or 0 for r in range(1, CUTOFF + 2)]), one.total or 0, one.types or 0, buckets)
    hot = table.filter("kind = 'hot'").groupBy("hid").agg(F.sum("total").alias("total"), F.sum("low").alias("low"), *sums).orderBy("hid").toPandas()
    if len(hot):
        level.hot = {"hid": hot.hid.to_numpy(), "low": hot.low.to_numpy(), "sums": hot[["total", *[f"n{r}" for r in range(1, CUTOFF + 1)]]].to_numpy()}
    return level


def fit_and_score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2, block_bytes: int | None = None, bucket_entries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Trains on the rows where ``train`` holds and scores every row.

    Returns the scores (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row) and the
    model's stored tables (level, bucket, payload), partitioned by kind in the shared folder.
    """
    spark = df.sparkSession
    common.short_batches(spark)
    block_bytes = block_bytes or int(BLOCK_BYTES * common.room(spark))
    bucket_entries = bucket_entries or int(BUCKET_ENTRIES * common.room(spark))
    source = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = common.stored(source.mapInArrow(tk.lean(_blocks(block_bytes)), "chunk long, payload binary, first binary, tokens long, trained long"), name="katz-blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(common.tasks(spark), -(-tokens // bucket_entries))
    asked = blocks.select("chunk", "first").mapInArrow(tk.lean(_ask_words(buckets)), _ROWS_DDL)
    tables = [common.stored(asked.groupBy("bucket").applyInArrow(_add_words(buckets), _OUT_DDL), ("kind",), "katz-1")]
    levels = [_summary(tables[0], buckets)]
    own = blocks.select("chunk", F.lit(0).alias("level"), F.lit(0).alias("bucket"), "payload")

    def with_answers() -> DataFrame:
        rows = own
        for t in tables:
            rows = rows.unionByName(t.filter("kind = 'answer'").select("chunk", "level", "bucket", "payload"))
        return rows.groupBy("chunk")

    for m in range(2, order + 1):
        asked = with_answers().applyInArrow(_ask(list(levels), buckets), _ROWS_DDL)
        tables.append(common.stored(asked.groupBy("bucket").applyInArrow(_add(buckets, m == order), _OUT_DDL), ("kind",), f"katz-{m}"))
        levels.append(_summary(tables[-1], buckets))

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(table: pa.Table) -> pa.Table:
        _, block = _block_of(table, levels)
        one = levels[0]
        base = np.log10((block.count + 0.1) / (one.total + 0.1 * (one.types + 1)))
        n = len(block.lengths)
        return pa.Table.from_arrays(
            [pa.array(block.ids, mask=~block.known), pa.array(~block.train), pa.array(block.lengths), pa.array(tk.sums(block.count > 0, block.at)), pa.array(np.full(n, one.total)), pa.array(np.add.reduceat(base, block.at[:-1])), pa.array(np.add.reduceat(np.log10(block.p), block.at[:-1]))],
            schema=schema,
        )

    scores = with_answers().applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    model = tables[0].filter("kind = 'model'").select("level", "bucket", "payload")
    for t in tables[1:]:
        model = model.unionByName(t.filter("kind = 'model'").select("level", "bucket", "payload"))
    return scores, model


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == 0
