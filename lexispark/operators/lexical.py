"""BM25 retrieval over token relations, and phrase search over postings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Bm25Config
from ..functions import text as tx
from .scores import ranked, top_k

#: Distinct query terms up to which the term side of a join is broadcast, and phrases up to which they are.
BROADCAST_TERMS, FEW_PHRASES = 200_000, 20_000


def tokens(docs: DataFrame, doc_id: str, text: str, stem: bool = True) -> DataFrame:
    """(doc_id, terms): every document, empty ones too."""
    c = F.col(text)
    return docs.select(F.col(doc_id).alias("doc_id"), (tx.stemmed(c) if stem else tx.tokenize(c)).alias("terms"))


def query_terms(queries: DataFrame, qid: str, text: str, cfg: Bm25Config) -> DataFrame:
    """(qid, term, qtf)"""
    c = F.col(text)
    terms = tx.stemmed(c) if cfg.stem else tx.tokenize(c)
    rows = queries.select(F.col(qid).alias("qid"), F.explode(terms if cfg.repeat_terms else F.array_distinct(terms)).alias("term"))
    return rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(docs: DataFrame, queries: DataFrame, cfg: Bm25Config = Bm25Config(), doc_id: str = "doc_id", doc_text: str = "text", qid: str = "item_id", query_text: str = "text") -> DataFrame:
    """(qid, doc_id, score) of all documents with a positive score.

    Every row is a document of its own in the counts; of rows with one id the best score stands for the id, and rows without an
    id are counted but never found. Postings are cut to the query terms before they are counted, so only those tokens are
    shuffled; empty documents count in the number of documents and the average length.
    """
    toks = tokens(docs, doc_id, doc_text, cfg.stem).withColumn("row", F.monotonically_increasing_id())
    stats = toks.agg(F.count("*").cast("double").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    wanted = query_terms(queries, qid, query_text, cfg)
    terms = wanted.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    post = toks.select("row", "doc_id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    post = post.join(F.broadcast(terms) if few else terms, "term", "left_semi").groupBy("term", "row", "doc_id", "dl").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weights = wanted.join(df, "term").join(F.broadcast(stats)).select("qid", "term", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"), "avgdl")
    part = F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")) + 1e-9)
    hits = post.filter("doc_id is not null").join(weights, "term").groupBy("qid", "row", "doc_id").agg(F.sum(F.col("w") * part).alias("score"))
    return hits.filter("score > 0").groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


#: Entries of the query side (terms of queries) up to which tasks hold it, and cells or products of one step of a task.
MOST_ENTRIES, STEP = 2_000_000, 2_000_000
#: Rows of a query that a task ranks, about, and scores that the bounds between such rows are found from.
PART, SAMPLED = 250_000, 500_000


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, cfg: Bm25Config = Bm25Config(), doc_id: str = "doc_id", doc_text: str = "text", qid: str = "item_id", query_text: str = "text", most_entries: int = MOST_ENTRIES) -> DataFrame:
    """(qid, doc_id, score, rank), as ``bm25`` and its k best; ids are longs.

    Up to a checked number of query terms, summed over the queries, documents are scored where they are read, all queries at
    once: one scan counts documents per term, a second multiplies each slice of postings with the sparse query weights and
    keeps its k best, so neither postings nor (query, document) pairs are shuffled, however many queries there are. Beyond that
    number the relational form does the same with shuffles.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    side = _query_side(texts, query_terms(queries, qid, query_text, cfg), cfg, most_entries)
    if side is None:
        return top_k(bm25(docs, queries, cfg, doc_id, doc_text, qid, query_text), ["qid"], k)
    known, state, _ = side
    result = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids = state.value[0]
        if not len(qids):
            return
        for docs_, s in _scores(batches, known.value, state.value, cfg, len(qids)):
            top = min(k, len(docs_))
            # ties in the rounded score go to the smaller id
            place = np.lexsort((np.broadcast_to(docs_[:, None], s.shape), -np.round(s, 6)), axis=0)[:top]
            got = np.take_along_axis(s, place, axis=0)
            q, keep = np.broadcast_to(qids, got.shape), got > 0
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(docs_[place][keep]), pa.array(got[keep])], schema=result)

    hits = texts.mapInArrow(score, "qid long, doc_id long, score double")
    return top_k(hits.groupBy("qid", "doc_id").agg(F.max("score").alias("score")), ["qid"], k)


def bm25_every(docs: DataFrame, queries: DataFrame, cfg: Bm25Config = Bm25Config(), doc_id: str = "doc_id", doc_text: str = "text", qid: str = "item_id", query_text: str = "text", most_entries: int = MOST_ENTRIES, part: int = PART) -> DataFrame:
    """(qid, doc_id, score, rank) of every document for every query: those without a query term rank too, with score 0.

    The result has a row for each query and document, which is what is asked for; use it with few queries. Documents are scored
    where they are read, as in ``bm25_top``, and a row is shuffled once, to the task that ranks it: a query's rows are cut by
    score and id into parts of bounded size, whose sizes another scan has counted. Ids that are no integers, and more query
    terms than ``most_entries``, take the relational form.
    """
    ids = queries.select(F.col(qid).alias("qid")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text"))
    kinds = [docs.schema[doc_id].dataType, queries.schema[qid].dataType]
    asked = side = None
    if all(isinstance(kind, T.IntegralType) for kind in kinds):
        asked = ids.select(F.col("qid").cast("long")).limit(most_entries + 1).toArrow().column("qid").combine_chunks().sort()
        if len(asked) <= most_entries:
            # a query without an id is told from no other, so nothing is found for it
            side = _query_side(texts, query_terms(queries.filter(F.col(qid).isNotNull()), qid, query_text, cfg), cfg, most_entries)
    if side is None:
        every = docs.select(F.col(doc_id).alias("doc_id")).filter("doc_id is not null").distinct().join(F.broadcast(ids))
        scored = every.join(bm25(docs, queries, cfg, doc_id, doc_text, qid, query_text), ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return ranked(scored, ["qid"]).withColumn("rank", F.col("rank").cast("long"))
    known, state, n = side
    place = np.searchsorted(asked.drop_null().to_numpy(zero_copy_only=False), state.value[0])
    schema = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(asked):
            return
        for docs_, found in _scores(batches, known.value, state.value, cfg, len(asked)):
            s = np.zeros((len(docs_), len(asked)))
            s[:, place] = found
            columns = [np.tile(np.arange(len(asked)), len(docs_)), np.repeat(docs_, len(asked)), s.ravel()]
            yield from pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema).to_batches(200_000)

    source, first = texts, score
    if texts.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        # of rows with one id the best score stands for the id
        source = texts.mapInArrow(score, "q long, doc_id long, score double").groupBy("q", "doc_id").agg(F.max("score").alias("score"))
        first = iter
    # bounds between parts: they only say which task ranks a row, so those of some documents do
    some = max(1, SAMPLED // max(1, len(asked)))
    parts = min(-(-n // part), max(1, some // 20)) if len(asked) else 1
    bounds = np.zeros((2, 0, len(asked)))
    if parts > 1:
        few = texts.sample(min(1.0, some / n), seed=42).mapInArrow(score, "q long, doc_id long, score double").toArrow()
        q, d, key = few.column(0).to_numpy(), few.column(1).to_numpy(), _key(few.column(2).to_numpy())
        order = np.lexsort((d, -key, q)).reshape(len(asked), -1)
        # each document has a score for every query
        at = order[:, np.arange(1, parts) * order.shape[1] // parts].T if order.size else np.zeros((0, len(asked)), dtype=np.int64)
        bounds = key[at], d[at]
    parts = len(bounds[0]) + 1
    cuts = texts.sparkSession.sparkContext.broadcast(bounds)

    def part_of(batch: pa.RecordBatch) -> np.ndarray:
        """The number of the row's part among those of all queries: as many bounds as come before it, by score and id."""
        q, d, key = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _key(batch.column(2).to_numpy())
        out = q * parts
        for k, i in zip(*cuts.value):
            at, over = k[q], i[q]
            out += (key < at) | ((key == at) & (d > over))
        return out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(asked) * parts, dtype=np.int64)
        for batch in first(batches):
            sums += np.bincount(part_of(batch), minlength=len(sums))
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["part", "n"])

    sizes = np.zeros((len(asked), parts), dtype=np.int64)
    if parts > 1:
        got = source.mapInArrow(count, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).toArrow()
        sizes.ravel()[got.column(0).to_numpy()] = got.column(1).to_numpy()
    before = texts.sparkSession.sparkContext.broadcast((np.cumsum(sizes, axis=1) - sizes).ravel())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in first(batches):
            yield pa.RecordBatch.from_arrays([asked.take(batch.column(0)), batch.column(1), batch.column(2), pa.array(before.value[part_of(batch)])], names=["qid", "doc_id", "score", "before"])

    rows = source.mapInArrow(placed, "qid long, doc_id long, score double, before long")
    # no two parts of a query with rows have as many rows before them
    within = Window.partitionBy("qid", "before").orderBy(F.floor(F.col("score") * 1e6 + 0.5).desc(), "doc_id")
    return rows.select(F.col("qid").cast(kinds[1]), F.col("doc_id").cast(kinds[0]), "score", (F.col("before") + F.row_number().over(within)).alias("rank"))


def _key(score: np.ndarray) -> np.ndarray:
    """Scores in millionths: what ranks follow."""
    return np.floor(score * 1e6 + 0.5)


def _query_side(texts: DataFrame, wanted: DataFrame, cfg: Bm25Config, most_entries: int) -> tuple[Broadcast, Broadcast, int] | None:
    """The terms' numbers; (query ids, bounds of each term's entries, their queries' places, their weights, average length);
    and the number of documents. None where the queries have more entries than tasks are to hold."""
    rows = wanted.select(F.col("qid").cast("long").alias("qid"), "term", "qtf").limit(most_entries + 1).toArrow()
    if rows.num_rows > most_entries:
        return None
    spark = texts.sparkSession
    terms, of = np.unique(np.array(rows.column("term").to_pylist(), dtype=object).astype(str), return_inverse=True)
    qids, who = np.unique(rows.column("qid").to_numpy(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    number = {str(t): i for i, t in enumerate(terms)}
    known = spark.sparkContext.broadcast(number)
    counted = pa.schema([("term", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(len(known.value), dtype=np.int64), 0, 0
        for _, _, term, _, sizes in _postings(batches, known.value, cfg.stem, 512):
            df += np.bincount(term, minlength=len(df))
            n, length = n + len(sizes), length + int(sizes.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2]]).astype(np.int32)), pa.array(np.concatenate([df[some], [n, length]]))], schema=counted)

    totals = {r.term: r.n for r in texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, length = totals.pop(-1, 0), totals.pop(-2, 0)
    df = np.zeros(len(terms))
    df[list(totals)] = list(totals.values())
    average = length / n if n else 0.0
    idfs = np.where(df > 0, np.log((n - df + 0.5) / (df + 0.5) + 1), 0.0)
    at = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(terms)))])
    weight = (rows.column("qtf").to_numpy() * idfs[of])[order]
    return known, spark.sparkContext.broadcast((qids, at, who[order], weight, average)), n


def _scores(batches: Iterator[pa.RecordBatch], number: dict[str, int], state: tuple, cfg: Bm25Config, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of (doc_id, text) of which ``STEP`` holds a score for each of ``width`` queries: ids, each once, and their
    scores (ids x queries with terms)."""
    qids, at, who, weight, average = state
    for docs_, doc, term, tf, sizes in _postings(batches, number, cfg.stem, max(1, min(512, STEP // width))):
        if not len(docs_):
            continue
        part = tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * sizes[doc] / average) + 1e-9)
        each = at[term + 1] - at[term]
        s = np.zeros(len(docs_) * len(qids))
        bounds = np.searchsorted(np.cumsum(each), np.arange(STEP, int(each.sum()) + STEP, STEP), "right")
        for lo, hi in zip([0, *bounds[:-1]], bounds) if len(each) else ():
            hi = min(max(hi, lo), len(each))
            i = _ranges(at[term[lo:hi]], each[lo:hi])
            s += np.bincount(np.repeat(doc[lo:hi] * len(qids), each[lo:hi]) + who[i], weights=np.repeat(part[lo:hi], each[lo:hi]) * weight[i], minlength=len(s))
        s = s.reshape(len(docs_), len(qids))
        same, first = np.unique(docs_, return_inverse=True)
        if len(same) < len(docs_):
            best = np.zeros((len(same), len(qids)))
            np.maximum.at(best, first, s)
            docs_, s = same, best
        yield docs_, s


_TOKEN = re.compile(tx.TOKEN)
_SUFFIX = re.compile(f"^(.{{4,}}?)(?:{'|'.join(tx.SUFFIXES)})$")
_CYRILLIC = re.compile("[Ѐ-ӿ]")


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each run of the given length, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _postings(batches: Iterator[pa.RecordBatch], number: dict[str, int], stem: bool, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For slices of (doc_id, text): the ids of the documents that have one; place, term number and count of each of their
    query terms; and the lengths of these documents. Documents without an id come in slices of their own, without ids."""
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            some = batch.slice(lo, most)
            found, at, sizes = [], [], []
            for d, text in enumerate(some.column(1).to_pylist()):
                words = _TOKEN.findall((text or "").lower())
                if stem and text and _CYRILLIC.search(text):
                    words = [_SUFFIX.sub(r"\1", w) for w in words]
                own = [i for w in words if (i := number.get(w)) is not None]
                found += own
                at += [d] * len(own)
                sizes.append(len(words))
            t = max(1, len(number))
            pairs, tf = np.unique(np.array(at, dtype=np.int64) * t + np.array(found, dtype=np.int64), return_counts=True)
            yield from _by_id(some.column(0), pairs // t, pairs % t, tf, np.array(sizes, dtype=np.int64))


def _by_id(ids: pa.Array, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    if not ids.null_count:
        yield ids.to_numpy(), doc, term, tf, sizes
        return
    there = ids.is_valid().to_numpy(zero_copy_only=False)
    for keep, named in ((there, ids.drop_null().to_numpy(zero_copy_only=False)), (~there, np.zeros(0, dtype=np.int64))):
        place, own = np.cumsum(keep) - 1, keep[doc]
        yield named, place[doc[own]], term[own], tf[own], sizes[keep]


def phrase_hits(docs: DataFrame, phrases: DataFrame, doc_id: str = "doc_id", text: str = "text", phrase: str = "phrase", few: int = FEW_PHRASES) -> DataFrame:
    """(phrase, doc_id): documents with all tokens of the phrase, in which its pattern then matches.

    Up to a checked number of phrases they are broadcast: a document is tested against the phrases of which it has the rarest
    token, where it is read, and texts do not move. Beyond it documents are found by relational division over postings cut to
    the phrases' tokens, and only the texts of those are joined.
    """
    parts = phrases.select(F.col(phrase).alias("phrase"), F.array_distinct(tx.tokenize(F.col(phrase))).alias("need")).filter(F.size("need") > 0).distinct()
    pattern = tx.phrase_pattern(F.col("phrase"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    words = F.array_distinct(tx.tokenize(F.col("_text")))
    wanted = parts.select("phrase", F.size("need").alias("n"), F.explode("need").alias("term"))
    if parts.limit(few + 1).count() <= few:
        # the longest token of a phrase is taken for the rarest
        keys = parts.select("phrase", "need", F.array_max(F.transform("need", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("term"), pattern.alias("_p"))
        some = own.select("doc_id", "_text", words.alias("_w"))
        hits = some.select("doc_id", "_text", "_w", F.explode("_w").alias("term")).join(F.broadcast(keys), "term")
        return hits.filter((F.size(F.array_except("need", "_w")) == 0) & F.rlike("_text", F.col("_p"))).select("phrase", "doc_id")
    post = own.select("doc_id", F.explode(words).alias("term"))
    both = post.join(wanted, "term").groupBy("phrase", "n", "doc_id").agg(F.count("*").alias("have")).filter("have = n")
    texts = own.join(both.select("doc_id").distinct(), "doc_id", "left_semi")
    return both.join(texts, "doc_id").filter(F.rlike(F.col("_text"), pattern)).select("phrase", "doc_id").distinct()
