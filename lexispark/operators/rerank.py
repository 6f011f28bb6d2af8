"""Reranking of candidates (qid, doc_id, score, rank) with pluggable scorers, and blends with their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .scores import min_max, ranked


def scored_by(pairs: DataFrame, load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]], query: str, text: str, out: str = "ce") -> DataFrame:
    """Adds a model's score of (query, text). ``load`` runs once in a worker and returns a function of two Series."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield model(q.fillna(""), t.fillna("")).astype(float)

    return pairs.withColumn(out, score(F.col(query), F.col(text)))


def overlap(pairs: DataFrame, query: str, text: str, out: str = "ce") -> DataFrame:
    """Built-in stand-in for a cross-encoder: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(tx.tokenize(F.col(query)))
    return pairs.withColumn(out, F.when(F.size(q) > 0, F.size(F.array_intersect(q, tx.tokenize(F.col(text)))) / F.size(q)).otherwise(F.lit(0.0)))


def blend_min_max(head: DataFrame, weight: float, floor: float, base: str = "score", ce: str = "ce", clip: bool = True) -> DataFrame:
    """(1 - w) * minmax(base) + w * minmax(max(0, ce - floor)), both over the query's candidates."""
    c = F.greatest(F.lit(0.0), F.col(ce) - floor) if clip else F.col(ce)
    df = min_max(min_max(head.withColumn("_c", c), ["qid"], base, "_b", 0.0), ["qid"], "_c", "_c", 0.0)
    return df.withColumn("blended", (1 - weight) * F.col("_b") + weight * F.col("_c")).drop("_b", "_c")


def blend_plain(head: DataFrame, weight: float, floor: float, base: str = "score", ce: str = "ce") -> DataFrame:
    """(1 - w) * base + w * max(0, ce - floor)."""
    return head.withColumn("blended", (1 - weight) * F.col(base) + weight * F.greatest(F.lit(0.0), F.col(ce) - floor))


def head_then_tail(candidates: DataFrame, head: int, by: str) -> DataFrame:
    """New ranks: the first ``head`` candidates by ``by``, then the others as they were."""
    first = F.col("rank") <= head
    w = Window.partitionBy("qid").orderBy(F.when(first, 0).otherwise(1), F.when(first, F.round(by, 6)).desc(), F.when(first, F.col("doc_id")), "rank")
    return candidates.withColumn("new_rank", F.row_number().over(w))


def blend_head(candidates: DataFrame, head: int, weight: float, base: str = "score", ce: str = "ce") -> DataFrame:
    """``blended`` for the first ``head`` candidates: (1 - w) * minmax(base) + w * minmax(ce), both over the head (a constant
    list gives 0); the others keep their raw score."""
    first = F.col("rank") <= head
    top = blend_min_max(candidates.filter(first), weight, 0.0, base, ce, clip=False)
    return top.unionByName(candidates.filter(~first).withColumn("blended", F.col(base).cast("double")))


def replaced_by_ce(candidates: DataFrame, head: int, k: int, ce: str = "ce") -> DataFrame:
    """The first ``head`` candidates by ce alone, ``k`` of them, as score and rank."""
    top = candidates.filter(F.col("rank") <= head).drop("rank").withColumn("score", F.col(ce))
    return ranked(top, ["qid"]).filter(F.col("rank") <= k)


def by_two_keys(candidates: DataFrame, first: str, second: str, out: str = "rank") -> DataFrame:
    """Ranks by two scores, both descending, then by id."""
    w = Window.partitionBy("qid").orderBy(F.round(first, 6).desc(), F.round(second, 6).desc(), "doc_id")
    return candidates.drop(out).withColumn(out, F.row_number().over(w))


def pool_size(rerank: int, final: int, judged: int) -> int:
    """Candidates to keep for the stages that follow."""
    return max(4 * rerank, 4 * final, 6 * judged)


def adaptive(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """Combines ce with a judge's 0-10 score and safety label; candidates without a judgement keep ce.

    Contraindicated 0; below 3: 0.3 g; from 8: 0.8 g + 0.2 c; from 5: 0.6 g + 0.4 c; else 0.3 g + 0.7 c, with g the score
    over 10 and c clamped to [0, 1].
    """
    j = candidates.join(judged.select("qid", "doc_id", "llm_score", "safety"), ["qid", "doc_id"], "left")
    g, c, s = F.col("llm_score") / 10.0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ce"))), F.col("llm_score")
    final = F.when(s.isNull(), F.col("ce")).when(F.col("safety") == "contraindicated", 0.0).when(s < 3, 0.3 * g).when(s >= 8, 0.8 * g + 0.2 * c).when(s >= 5, 0.6 * g + 0.4 * c).otherwise(0.3 * g + 0.7 * c)
    return ranked(j.withColumn("final", final), ["qid"], "final")


def select_and_backfill(candidates: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """A judge's ordered selection (qid, doc_id, position, safety) first, then candidates by ce, k in all.

    score = 0.65 * (1 - (place - 1) / k) + 0.35 * ce, times 0.25 where contraindicated and 0.75 with caution.
    """
    both = candidates.join(selected, ["qid", "doc_id"], "left")
    w = Window.partitionBy("qid").orderBy(F.when(F.col("position").isNull(), 1).otherwise(0), "position", F.round("ce", 6).desc(), "doc_id")
    placed = both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    factor = F.when(F.col("safety") == "contraindicated", 0.25).when(F.col("safety") == "caution", 0.75).otherwise(1.0)
    return placed.withColumn("final", (0.65 * (1 - (F.col("place") - 1) / float(k)) + 0.35 * F.col("ce")) * factor)


#: Marks of a refusal for quota (fixed value).
QUOTA = r"quota|rate limit|resource_exhausted|\b429\b"


def parsed_replies(replies: DataFrame, text: str, schema: str) -> DataFrame:
    """Adds ``reply`` (a struct of the schema, from a model's JSON text, fences and cut-off tails repaired) and ``error``.

    Marks of a refusal count before the JSON, or anywhere where there is none or it begins with an error; ids, scores and texts
    within a reply are data.
    """
    from ..sources.readers import repaired_json

    df = replies.withColumn("_j", repaired_json(F.coalesce(F.col(text), F.lit("")))).withColumn("reply", F.from_json("_j", schema))
    ok = F.try_parse_json("_j").isNotNull() & (F.col("_j") != "")
    low = F.lower(F.col(text))
    said = F.when(F.rlike(low, F.lit(r"""^[^{]*\{\s*["']error["']\s*:""")), low).otherwise(F.regexp_extract(low, r"^[^{]*", 0))
    why = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty").when(F.rlike(said, F.lit(QUOTA)), "quota").when(~ok, "invalid")
    return df.withColumn("error", why).withColumn("reply", F.when(why.isNull(), F.col("reply"))).drop("_j")


def judged_by_replies(candidates: DataFrame, replies: DataFrame, text: str = "text") -> DataFrame:
    """(qid, doc_id, llm_score, safety) from stored replies with a list of candidates; unknown documents are left out."""
    schema = "candidates array<struct<drug_id: bigint, score: double, safety_label: string>>"
    parsed = parsed_replies(replies, text, schema).filter("error is null").select("qid", F.explode("reply.candidates").alias("c"))
    rows = parsed.select("qid", F.col("c.drug_id").alias("doc_id"), F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("c.score"))).alias("llm_score"), F.coalesce("c.safety_label", F.lit("ok")).alias("safety"))
    return rows.join(candidates.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").dropDuplicates(["qid", "doc_id"])


#: Values of a triage frame's coarse fields; anything else is unknown (fixed values).
AGE_GROUPS = ["infant", "child", "adult", "elderly", "pregnant", "unknown"]
SEVERITIES = ["mild", "moderate", "severe", "unknown"]
URGENCIES = ["self_care", "routine", "urgent", "emergency", "unknown"]
FRAME = "original_query string, primary_complaint string, symptoms array<string>, possible_conditions array<string>, age_group string, severity string, urgency string, red_flags array<string>, notes string"


def triage_frames(queries: DataFrame, replies: DataFrame, text: str = "reply") -> DataFrame:
    """(qid, frame fields…, error) for every query, from stored replies (qid, reply) of a language model.

    A missing field is empty, a coarse field that is none of its values is unknown, red flags raise urgency to urgent at least,
    and a query whose reply is missing or cannot be read has an empty frame and the error's name.
    """
    parsed = parsed_replies(replies.select("qid", F.col(text).alias("_text")), "_text", FRAME).select("qid", F.col("reply").alias("f"), "error")
    j = queries.select("qid", F.col("text").alias("q")).join(parsed, "qid", "left")
    none = F.array().cast("array<string>")
    coarse = lambda c, values: F.when(F.lower(F.trim(c)).isin(values), F.lower(F.trim(c))).otherwise("unknown")
    flags = F.coalesce("f.red_flags", none)
    urgency = coarse(F.col("f.urgency"), URGENCIES)
    return j.select(
        "qid",
        F.coalesce(tx.filled(F.col("f.original_query")), F.col("q")).alias("original_query"),
        F.coalesce("f.primary_complaint", F.lit("")).alias("primary_complaint"),
        *[F.coalesce(f"f.{c}", none).alias(c) for c in ("symptoms", "possible_conditions")],
        coarse(F.col("f.age_group"), AGE_GROUPS).alias("age_group"),
        coarse(F.col("f.severity"), SEVERITIES).alias("severity"),
        F.when((F.size(flags) > 0) & ~urgency.isin("urgent", "emergency"), "urgent").otherwise(urgency).alias("urgency"),
        flags.alias("red_flags"),
        F.coalesce("f.notes", F.lit("")).alias("notes"),
        F.when(F.col("f").isNull(), F.coalesce("error", F.lit("missing"))).alias("error"),
    )
