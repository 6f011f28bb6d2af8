"""From passages to entities, and between ways of naming them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curation import by_hash, ring
from .scores import numbered


def group_by_entity(hits: DataFrame, entity: str, section: str = "section") -> DataFrame:
    """(qid, entity, score, section, items): the best passage's score and section, and how many there are."""
    best = F.max(F.struct(F.round("score", 6).alias("s"), F.struct((-F.col("doc_id")).alias("d"), F.col(section).alias("section")).alias("x")))
    g = hits.groupBy("qid", F.col(entity).alias("entity")).agg(best.alias("b"), F.count("*").alias("items"))
    return g.select("qid", "entity", F.col("b.s").alias("score"), F.col("b.x.section").alias("section"), "items")


def section_boost(hits: DataFrame, sections: list[str], boost: float, section: str = "section") -> DataFrame:
    """Scores of good sections times 1 + boost."""
    good = F.lower(F.col(section)).isin([s.lower() for s in sections])
    return hits.withColumn("score", F.when(good, F.col("score") * (1 + boost)).otherwise(F.col("score")))


def ids_from_counts(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, place): each key as often as its count, numbered."""
    return counts.filter(F.col(n) > 0).select(key, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("place"))


def missing_base(chunks: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """One row: chunks whose document is in the base, and those whose is not."""
    both = chunks.select(key).join(base.select(key).distinct().withColumn("_b", F.lit(1)), key, "left")
    return both.agg(F.count("_b").alias("matched"), F.count_if(F.col("_b").isNull()).alias("missing"))


def gold_level(gold: DataFrame, docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, level): whether a query's gold ids are documents, passages, unknown, or none."""
    d, p = docs.select("doc_id").distinct().withColumn("_d", F.lit(1)), passages.select(F.col("passage_id").alias("doc_id")).distinct().withColumn("_p", F.lit(1))
    j = gold.join(d, "doc_id", "left").join(p, "doc_id", "left").groupBy("qid").agg(F.count("doc_id").alias("n"), F.count("_d").alias("nd"), F.count("_p").alias("np"))
    return j.select("qid", F.when(F.col("n") == 0, "none").when(F.col("nd") > 0, "doc").when(F.col("np") > 0, "passage").otherwise("unknown").alias("level"))


def by_id_or_order(gold: DataFrame, predictions: DataFrame, least: float = 0.2) -> DataFrame:
    """(id, predicted): by id; where fewer than ``least`` of the ids are shared, by the place in the files (column ord).

    Both answers are one plan: the share decides row by row, so nothing is counted while the plan is made.
    """
    place = lambda df: numbered(df.withColumn("_o", F.lpad(F.hex("ord"), 16, "0")), [], "_o", "ord", "_n", digits=12)
    by_id = predictions.select("id", F.col("predicted").alias("_1")).dropDuplicates(["id"]).withColumn("_s", F.lit(1))
    by_place = place(predictions.select("ord", F.col("predicted").alias("_2"))).select("_n", "_2")
    both = place(gold.select("id", "ord")).join(by_id, "id", "left").join(by_place, "_n", "left")
    share = gold.select("id").join(by_id.select("id", "_s"), "id", "left").agg(F.avg(F.coalesce("_s", F.lit(0))).alias("_share"))
    return both.join(F.broadcast(share)).select("id", F.when(F.col("_share") >= least, F.col("_1")).otherwise(F.col("_2")).alias("predicted"))


def deltas(per_query: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(metric, base, other, delta): means of paired columns, largest gain first by ``delta``."""
    rows = [F.struct(F.lit(m).alias("metric"), F.avg(a).alias("base"), F.avg(b).alias("other")) for m, (a, b) in pairs.items()]
    one = per_query.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return one.withColumn("delta", F.col("other") - F.col("base"))


def policy(queries: DataFrame, table: DataFrame) -> DataFrame:
    """Each query with its intent's settings, or those of intent *."""
    named = table.select([F.col(c).alias(f"_p_{c}") for c in table.columns])
    rest = table.filter("intent = '*'").select([F.col(c).alias(f"_d_{c}") for c in table.columns])
    j = queries.join(named, F.col("intent") == F.col("_p_intent"), "left").join(F.broadcast(rest.limit(1)), F.lit(True), "left")
    return j.select(*queries.columns, *[F.coalesce(f"_p_{c}", f"_d_{c}").alias(c) for c in table.columns if c != "intent"])


def policy_weights(pairs: DataFrame, text: Column, rules: list[tuple[str, float]]) -> DataFrame:
    """(qid, doc_id, weight): the sum of the weights of the patterns that the document's text matches."""
    parts = [F.when(F.rlike(text, F.lit(f"(?iuU){p}")), float(w)).otherwise(0.0) for p, w in rules]
    return pairs.select("qid", "doc_id", sum(parts, F.lit(0.0)).alias("weight"))


@dataclass(frozen=True)
class Rule:
    """A weighted pattern. Alternatives stand between |, and * for any ending of a word."""

    pattern: str
    weight: float


@dataclass(frozen=True)
class PolicyIntent:
    """Patterns of queries and what they change: rules that are added, and patterns whose weight is replaced."""

    name: str
    match_any: tuple[str, ...]
    rules: tuple[Rule, ...] = ()
    overrides: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class Policy:
    """Boosts (positive weights) and demotions (negative ones), intents, and pairs (wins, ignored): where the first pattern
    occurs in a document, a demotion by the second does not count."""

    rules: tuple[Rule, ...] = ()
    intents: tuple[PolicyIntent, ...] = ()
    exceptions: tuple[tuple[str, str], ...] = ()


def rule_pattern(pattern: str) -> str:
    """The regular expression of a rule: literals between |, * for word characters."""
    return "(?iuU)" + "|".join(re.escape(p.strip()).replace(r"\*", r"\w*") for p in pattern.split("|"))


def by_policy(pairs: DataFrame, policy: Policy, query: str, text: str, tiebreakers: list[Column] | None = None) -> DataFrame:
    """``pairs`` (qid, doc_id, query, text, …) with intents, weight and rank: the sum of the weights of the policy's rules, and
    of the rules of the intents that the query matches, that occur in the text; ties by ``tiebreakers``, then by id."""
    q, t = F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    occurs = lambda p: F.rlike(t, F.lit(rule_pattern(p)))
    active = {i.name: F.rlike(q, F.lit("(?iuU)" + "|".join(f"(?:{p})" for p in i.match_any))) for i in policy.intents}
    spared = lambda p: [occurs(wins) for wins, lost in policy.exceptions if lost == p]

    def worth(rule: Rule, on: Column | None = None) -> Column:
        w = F.lit(float(rule.weight))
        for i in policy.intents:
            for o in i.overrides:
                if o.pattern == rule.pattern:
                    w = F.when(active[i.name], float(o.weight)).otherwise(w)
        hit = occurs(rule.pattern) if on is None else on & occurs(rule.pattern)
        if rule.weight < 0:
            for s in spared(rule.pattern):
                hit = hit & ~s
        return F.when(hit, w).otherwise(0.0)

    parts = [worth(r) for r in policy.rules] + [worth(r, active[i.name]) for i in policy.intents for r in i.rules]
    names = F.array_compact(F.array(*[F.when(a, F.lit(n)) for n, a in active.items()])) if active else F.array().cast("array<string>")
    out = pairs.withColumn("intents", names).withColumn("weight", sum(parts, F.lit(0.0)))
    w = Window.partitionBy("qid").orderBy(F.round("weight", 6).desc(), *(tiebreakers or []), "doc_id")
    return out.withColumn("rank", F.row_number().over(w))


def training_pairs(items: DataFrame, key: str, name: str, categories: Column, templates: list[str], most: int = 4, most_categories: int = 2, negatives: int = 3, seed: str = "3", canned: list[str] | None = None) -> DataFrame:
    """(key, query, positive, category, negatives): templated queries of an item's first categories, with items of another one.

    Negatives are the first ``negatives`` items by a seeded hash of the category before in a seeded ring, or the ``canned``
    texts where given. Each bin of hashes keeps its first items before a category's are compared.
    """
    rows = items.select(F.col(key).alias("key"), F.col(name).alias("positive"), F.explode(F.slice(categories, 1, most_categories)).alias("category"))
    filled = F.transform(F.array(*[F.lit(t) for t in templates]), lambda t: F.replace(F.replace(t, F.lit("{name}"), F.col("positive")), F.lit("{category}"), F.col("category")))
    out = rows.withColumn("query", F.explode(F.slice(filled, 1, most)))
    if canned is not None:
        return out.select("key", "query", "positive", "category", F.array(*[F.lit(c) for c in canned[:negatives]]).alias("negatives"))
    pool = rows.withColumn("_o", by_hash(seed, "key")).withColumn("_b", F.left("_o", F.lit(3)))
    upto = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_o", "key"))
    pool = pool.withColumn("_n", upto(["category", "_b"])).filter(F.col("_n") <= negatives).withColumn("_n", upto(["category"])).filter(F.col("_n") <= negatives)
    pool = pool.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "positive"))), lambda x: x["positive"]).alias("negatives"))
    before = ring(rows.select("category").distinct(), "category", seed).select(F.col("next").alias("category"), F.col("g").alias("other")).filter("category <> other")
    return out.join(before, "category").join(pool.withColumnRenamed("category", "other"), "other").select("key", "query", "positive", "category", "negatives")
