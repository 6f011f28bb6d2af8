"""Disease priors: boosts and query terms by condition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norms
from . import substrings

#: Endings under which a condition's prior may be filed, tried in this order (fixed values).
SUFFIXES = ("_basic", "_general", "_symptoms")


def lookup(conditions: DataFrame, priors: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, few: int = substrings.FEW) -> DataFrame:
    """(qid, condition, prior_id): the prior named as the condition, else with one of the suffixes, else the first (by ord) whose
    name contains it.

    Exact and suffixed names are one equi-join; only the conditions left over are compared by containment. What is found, a row
    for each distinct condition, is broadcast up to a checked number of them; the queries' conditions never are.
    """
    p = priors.select(F.col("id").alias("prior_id"), "ord").groupBy("prior_id").agg(F.min("ord").alias("ord"))
    names = conditions.select("condition").distinct()
    keys = names.select("condition", F.posexplode(F.array("condition", *[F.concat("condition", F.lit(s)) for s in suffixes])).alias("how", "prior_id"))
    first = lambda df: df.withColumn("_n", F.row_number().over(Window.partitionBy("condition").orderBy("how", "prior_id"))).filter("_n = 1").select("condition", "prior_id")
    sized = names.limit(few + 1).count() <= few
    side = lambda df: F.broadcast(df) if sized else df.hint("merge")
    named = first(side(keys).join(p, "prior_id"))
    rest = names.join(side(named), "condition", "left_anti")
    loose = first(substrings.contained(p, "prior_id", rest, "condition", few).withColumn("how", F.col("ord")))
    return conditions.select("qid", "condition").distinct().join(side(named.unionByName(loose)), "condition").select("qid", "condition", "prior_id")


def brand_docs(priors: DataFrame, docs: DataFrame, name: str = "name", few: int = substrings.FEW) -> DataFrame:
    """(prior_id, doc_id): documents whose name equals, contains or is part of one of the prior's brands."""
    brands = priors.select(F.col("id").alias("prior_id"), F.explode("brands_opt").alias("b")).select("prior_id", F.lower(F.trim("b")).alias("brand")).filter("brand <> ''").distinct()
    titles = docs.select("doc_id", F.lower(F.trim(name)).alias("title")).filter("title <> ''")
    inside = substrings.contained(titles, "title", brands, "brand", few)
    around = substrings.contained(brands, "brand", titles, "title", few)
    return inside.select("prior_id", "doc_id").unionByName(around.select("prior_id", "doc_id")).distinct()


def boosts(hits: DataFrame, queries: DataFrame, priors: DataFrame, inn_docs: DataFrame, conditions: DataFrame, scale: float = 300.0, brands: DataFrame | None = None) -> DataFrame:
    """(qid, doc_id, score, boost): each prior of a query adds boost * scale once to every document with one of its substances
    or brands; the boosts of several conditions add up.

    A prior is vetoed where the query contains one of its negative triggers. ``inn_docs`` is (inn, doc_id), ``brands`` is
    (prior_id, doc_id) as ``brand_docs`` gives it.
    """
    q = queries.select("qid", F.lower("text").alias("q"))
    chosen = lookup(conditions, priors).join(priors.withColumnRenamed("id", "prior_id"), "prior_id").join(q, "qid")
    live = chosen.filter(~F.exists(F.coalesce("neg_triggers", F.array().cast("array<string>")), lambda t: F.contains(F.col("q"), F.lower(t))) & (F.col("boost") > 0))
    docs = priors.select(F.col("id").alias("prior_id"), F.explode("inn").alias("i")).select("prior_id", F.lower(F.replace("i", F.lit("_"), F.lit(" "))).alias("inn")).join(inn_docs.select(F.lower("inn").alias("inn"), "doc_id"), "inn").select("prior_id", "doc_id")
    if brands is not None:
        docs = docs.unionByName(brands.select("prior_id", "doc_id"))
    # two conditions may lead to one prior, which then counts for both
    per_doc = live.select("qid", "condition", "prior_id", "boost").distinct().join(docs.distinct(), "prior_id").groupBy("qid", "doc_id").agg((F.sum("boost") * scale).alias("boost"))
    return hits.select("qid", "doc_id", "score").join(per_doc, ["qid", "doc_id"], "full").select("qid", "doc_id", (F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).alias("score"), F.coalesce("boost", F.lit(0.0)).alias("boost"))


def first_prior(queries: DataFrame, priors: DataFrame, most_terms: int = 3, as_patterns: bool = False) -> DataFrame:
    """(qid, prior_id, terms): the first prior (by ord) of the query's intent with a trigger in it and no negative trigger.

    Triggers are joined with the queries that contain them; with ``as_patterns`` a trigger is a pattern, or stands for any word
    that begins with it, and the triggers, one row each, are tried on every query.
    """
    p = priors.select(F.col("id").alias("prior_id"), F.col("intent").alias("p_intent"), "ord", "inn")
    sides = {}
    for side in ("triggers", "neg_triggers"):
        t = priors.select(F.col("id").alias("prior_id"), F.explode(side).alias("t")).distinct()
        q = queries.select("qid", F.lower("text").alias("_q"))
        if as_patterns:
            found = q.join(t.withColumn("_p", norms.prior_pattern(F.col("t"))), F.rlike("_q", F.col("_p")))
        else:
            found = substrings.contained(q, "_q", t.withColumn("_t", F.lower("t")), "_t")
        sides[side] = found.select("qid", "prior_id").distinct()
    both = sides["triggers"].join(sides["neg_triggers"], ["qid", "prior_id"], "left_anti").join(p, "prior_id").join(queries.select("qid", "intent"), "qid").filter("p_intent is null or p_intent = intent")
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("ord"))).filter("_n = 1")
    return first.select("qid", "prior_id", F.slice("inn", 1, most_terms).alias("terms"))


def inn_index(docs: DataFrame, inns: DataFrame, composition: str = "text", few: int = substrings.FEW) -> DataFrame:
    """(inn, doc_id): substances whose name occurs in the composition."""
    names = inns.select("inn").distinct().withColumn("_inn", F.lower("inn"))
    return substrings.contained(docs.select("doc_id", F.lower(composition).alias("_c")), "_c", names, "_inn", few).select("inn", "doc_id").distinct()
