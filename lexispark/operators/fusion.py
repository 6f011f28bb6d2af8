"""Merging ranked lists (qid, source, doc_id, score, rank), and additive boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FusionConfig
from .scores import min_max, ranked


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for source, w in weights.items():
        out = F.when(F.col("source") == source, float(w)).otherwise(out)
    return out


def rrf(hits: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """(qid, doc_id, score): sum of w / (k + rank) over the lists."""
    w = _weight(weights) if weights else F.lit(1.0)
    return hits.groupBy("qid", "doc_id").agg(F.sum(w / (k + F.col("rank"))).alias("score"))


def weighted_min_max(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Each list to [0, 1] (a constant one to 0.5), then the weighted sum; a missing hit adds 0."""
    scaled = min_max(hits, ["qid", "source"], "score", "s", constant=0.5)
    return scaled.groupBy("qid", "doc_id").agg(F.sum(_weight(weights) * F.col("s")).alias("score"))


def weighted_min_max_union(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Missing scores are 0 before the lists are scaled over the union; a constant list gives 0."""
    sources = list(weights)
    wide = hits.groupBy("qid", "doc_id").agg(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col("score"))), F.lit(0.0)).alias(f"s_{s}") for s in sources])
    for s in sources:
        wide = min_max(wide, ["qid"], f"s_{s}", f"n_{s}", constant=0.0)
    total = sum((F.col(f"n_{s}") * float(weights[s]) for s in sources), F.lit(0.0))
    return wide.select("qid", "doc_id", total.alias("score"))


def fuse(hits: DataFrame, cfg: FusionConfig = FusionConfig()) -> DataFrame:
    """(qid, doc_id, score, rank) by the configured method."""
    if cfg.method == "rrf":
        out = rrf(hits, cfg.k)
    elif cfg.method == "wrrf":
        out = rrf(hits, cfg.k, cfg.weights)
    elif cfg.method == "minmax_union":
        out = weighted_min_max_union(hits, cfg.weights)
    elif cfg.method == "minmax":
        out = weighted_min_max(hits, cfg.weights)
    else:
        raise ValueError(f"unknown fusion method {cfg.method!r}")
    return ranked(out, ["qid"])


def union_boost(fused: DataFrame, union: DataFrame, boost: float = 0.05) -> DataFrame:
    """Adds ``boost`` to every (qid, doc_id) of ``union``, also to those the lists lack."""
    both = fused.select("qid", "doc_id", "score").unionByName(union.select("qid", "doc_id").distinct().withColumn("score", F.lit(float(boost))))
    return both.groupBy("qid", "doc_id").agg(F.sum("score").alias("score"))


def union_strength(fused: DataFrame, union: DataFrame, base: float = 0.05, slope: float = 0.15, most: int = 400) -> DataFrame:
    """Raises scores to at least base + slope * strength for the ``most`` first documents of the union (qid, doc_id, strength)."""
    w = Window.partitionBy("qid").orderBy(F.col("strength").desc(), "doc_id")
    some = union.groupBy("qid", "doc_id").agg(F.max("strength").alias("strength")).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    raised = some.select("qid", "doc_id", (base + slope * F.col("strength")).alias("score"))
    return fused.select("qid", "doc_id", "score").unionByName(raised).groupBy("qid", "doc_id").agg(F.max("score").alias("score"))


def union_cap(matches: DataFrame, order: list[str], cap: int, among: DataFrame | None = None) -> DataFrame:
    """First ``cap`` distinct documents per query in the order of conditions; ``among`` limits them to hits of a list."""
    if among is not None:
        matches = matches.join(among.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    first = matches.groupBy("qid", "doc_id").agg(F.min(F.struct(*order)).alias("_o"))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("_o", "doc_id"))).filter(F.col("_n") <= cap).select("qid", "doc_id", F.col("_n").alias("position"))


def force_include(ranked_hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Appends documents of ``extra`` behind the ranked ones and keeps each at its first place."""
    both = ranked_hits.select("qid", "doc_id", F.lit(0).alias("part"), F.col("rank").alias("pos")).unionByName(extra.select("qid", "doc_id", F.lit(1).alias("part"), F.col("position").alias("pos")))
    first = both.groupBy("qid", "doc_id").agg(F.min(F.struct("part", "pos")).alias("o"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("o", "doc_id"))).select("qid", "doc_id", "rank")
