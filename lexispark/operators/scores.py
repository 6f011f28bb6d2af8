"""Per-query score transforms and rank operations over (qid, source, doc_id, score) relations.

Ranks follow the score rounded to six places, then the id, so that ties and last-bit noise give one order everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(score: str = "score", doc: str = "doc_id") -> list[Column]:
    return [F.round(F.col(score), 6).desc(), F.col(doc).asc()]


def ranked(df: DataFrame, keys: list[str], score: str = "score", doc: str = "doc_id", out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by_score(score, doc))))


def top_k(df: DataFrame, keys: list[str], k: int, score: str = "score", doc: str = "doc_id") -> DataFrame:
    """The k best rows per key with their rank; plans as a partial and a final group limit."""
    return ranked(df, keys, score, doc).filter(F.col("rank") <= k)


def min_max(df: DataFrame, keys: list[str], score: str, out: str, constant: float = 0.5) -> DataFrame:
    """Scores to [0, 1] per key; a constant list gets ``constant``."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi - lo > 1e-12, (F.col(score) - lo) / (hi - lo)).otherwise(F.lit(constant)))


def softmax(df: DataFrame, keys: list[str], score: str, out: str, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*keys)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def over_max(df: DataFrame, keys: list[str], score: str, out: str) -> DataFrame:
    top = F.max(score).over(Window.partitionBy(*keys))
    return df.withColumn(out, F.when(top > 0, F.col(score) / top).otherwise(F.col(score)))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def numbered(df: DataFrame, keys: list[str], order: str, tie: str, out: str, digits: int = 4, weight: Column | None = None) -> DataFrame:
    """``df`` with ``out``, the place of each row (from 0) per key in the order of ``order``, a column of hexadecimal digits of
    one length, then ``tie``; with ``weight`` the sum of the weights before the row.

    Two levels: rows are numbered within the first ``digits`` digits, and these are summed up, so neither a hot key nor the
    lack of any key puts all rows into one task.
    """
    w = F.lit(1) if weight is None else weight
    d = df.withColumn("_bin", F.left(F.col(order), F.lit(digits))).withColumn("_w", w.cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_s"))
    base = sums.select(*keys, "_bin", F.coalesce(F.sum("_s").over(upto(Window.partitionBy(*keys).orderBy("_bin"))), F.lit(0)).alias("_base"))
    within = d.withColumn("_in", F.coalesce(F.sum("_w").over(upto(Window.partitionBy(*keys, "_bin").orderBy(order, tie))), F.lit(0)))
    return within.join(base, [*keys, "_bin"]).withColumn(out, F.col("_base") + F.col("_in")).drop("_bin", "_w", "_in", "_base", order)


def passages_to_docs(df: DataFrame, qid: str = "qid", doc: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Ranked passages to ranked documents: each document at its first passage."""
    first = df.groupBy(qid, doc).agg(F.min(rank).alias("first_rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("first_rank", doc)))
