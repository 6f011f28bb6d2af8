"""Ranking metrics. Variants differ on purpose and have names of their own; one pass gives all of a k.

Inputs: predictions (qid, doc_id, rank) and gold (qid, doc_id); results have a row for every gold query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(predictions: DataFrame, gold: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(qid, gold_n, rank, hit): ranked rows of gold queries; a query without predictions has one row with a null rank.

    With ``queries`` (qid) all of them have rows, those without gold with a gold_n of 0.
    """
    g = gold.select("qid", "doc_id").distinct()
    sizes = g.groupBy("qid").agg(F.count("*").alias("gold_n"))
    if queries is not None:
        sizes = queries.select("qid").distinct().join(sizes, "qid", "left").select("qid", F.coalesce("gold_n", F.lit(0)).alias("gold_n"))
    hits = predictions.select("qid", "doc_id", "rank").join(g.withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left")
    return sizes.join(hits, "qid", "left").select("qid", "gold_n", "rank", F.coalesce("hit", F.lit(0)).alias("hit"))


def _ideal(n: Column, most: int) -> Column:
    """DCG of n hits at the top, n at most ``most``."""
    terms = F.array(*[F.lit(1.0) / F.log2(F.lit(i + 1.0)) for i in range(1, most + 1)])
    return F.aggregate(F.slice(terms, F.lit(1), F.greatest(F.least(n, F.lit(most)), F.lit(0)).cast("int")), F.lit(0.0), lambda s, x: s + x)


METRICS = ["precision", "precision_shown", "hit", "recall", "recall_or_null", "recall_capped", "ndcg", "ndcg_shown", "ndcg_self", "ndcg_floor", "ndcg_unit", "f1", "rr", "rr_k"]


def metrics_at(judgements: DataFrame, ks: list[int], columns: list[str] | None = None) -> DataFrame:
    """(qid, gold_n, hits_n, first_hit_rank, <metric>@<k>…): per-query variants at all cut-offs, by one aggregation."""
    columns = METRICS if columns is None else columns
    hit = F.col("hit") == 1
    parts = [F.count("rank").alias("hits_n"), F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        top = F.col("rank") <= k
        parts += [
            F.coalesce(F.sum(F.when(top, F.col("hit"))), F.lit(0)).alias(f"hits_{k}"),
            F.coalesce(F.sum(F.when(top, 1)), F.lit(0)).alias(f"shown_{k}"),
            F.coalesce(F.sum(F.when(top & hit, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias(f"dcg_{k}"),
            F.min(F.when(top & hit, F.col("rank"))).alias(f"first_{k}"),
        ]
    got = judgements.groupBy("qid", "gold_n").agg(*parts)
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    gold, out = F.col("gold_n"), []
    for k in ks:
        hits, shown, dcg = (F.col(f"{c}_{k}") for c in ("hits", "shown", "dcg"))
        p, r = hits / k, safe(hits, gold)
        all_ = {
            "precision": p,
            "precision_shown": safe(hits, F.least(F.lit(k), shown)),
            "hit": F.when(hits > 0, 1.0).otherwise(0.0),
            "recall": r,
            "recall_or_null": F.when(gold > 0, hits / gold),
            "recall_capped": hits / (gold + 1e-9),
            "ndcg": safe(dcg, _ideal(gold, k)),
            "ndcg_shown": dcg / (_shown_ideal(gold, shown, k) + 1e-9),
            "ndcg_self": safe(dcg, _ideal(hits, k)),
            "ndcg_floor": dcg / _ideal(F.greatest(gold, F.lit(1)), k),
            "ndcg_unit": dcg,
            "f1": safe(2 * p * r, p + r),
            "rr": safe(F.lit(1.0), F.col("first").cast("double")),
            "rr_k": F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0)),
        }
        out += [all_[c].alias(f"{c}@{k}") for c in columns]
    return got.select("qid", "gold_n", "hits_n", F.coalesce("first", F.lit(0)).alias("first_hit_rank"), *out)


def metrics(judgements: DataFrame, k: int) -> DataFrame:
    """All per-query variants at cut-off k."""
    return metrics_at(judgements, [k]).select("qid", "gold_n", *[F.col(f"`{c}@{k}`").alias(c) for c in METRICS])


def per_query(predictions: DataFrame, gold: DataFrame, queries: DataFrame, ks: list[int]) -> DataFrame:
    """(qid, text, gold_n, hits_n, first_hit_rank, mrr, recall@k, precision@k, ndcg@k, must_avoid@k for each k) for every query.

    ``must_avoid@k`` is a placeholder of the format and always 0; ``violations`` has the figure itself.
    """
    table = metrics_at(judged(predictions, gold, queries), ks, ["recall", "precision", "ndcg"])
    first = F.col("first_hit_rank")
    names = [f"{m}@{k}" for k in ks for m in ("recall", "precision", "ndcg")]
    avoid = [F.lit(0.0).alias(f"must_avoid@{k}") for k in ks]
    return queries.select("qid", "text").join(table, "qid").select("qid", "text", "gold_n", "hits_n", "first_hit_rank", F.when(first > 0, 1.0 / first).otherwise(0.0).alias("mrr"), *[F.col(f"`{n}`") for n in names], *avoid)


def per_query_summary(table: DataFrame, ks: list[int]) -> DataFrame:
    """One row: queries, those with gold, those of which no gold was found anywhere, and means over the queries with gold."""
    has = F.col("gold_n") > 0
    means = [F.avg(F.when(has, F.col(f"`{m}@{k}`"))).alias(f"{m}@{k}") for k in ks for m in ("recall", "precision", "ndcg")]
    return table.agg(F.count("*").alias("queries"), F.count_if(has).alias("with_gold"), F.count_if(has & (F.col("first_hit_rank") == 0)).alias("misses"), F.avg(F.when(has, F.col("mrr"))).alias("mrr"), *means)


def harness(predictions: DataFrame, gold: DataFrame, queries: DataFrame, flags: dict[str, Column], ndcg_k: int = 10, recall_k: int = 50) -> DataFrame:
    """(subset, queries, ndcg, recall, mrr): means over the queries of each subset, ``all`` among them; empty subsets have no row."""
    table = metrics_at(judged(predictions, gold, queries), sorted({ndcg_k, recall_k}), ["ndcg", "recall", "rr"])
    names = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in flags.items()]))
    rows = queries.select("qid", F.explode(names).alias("subset")).join(table, "qid")
    return rows.groupBy("subset").agg(F.count("*").alias("queries"), F.avg(f"`ndcg@{ndcg_k}`").alias("ndcg"), F.avg(f"`recall@{recall_k}`").alias("recall"), F.avg(f"`rr@{ndcg_k}`").alias("mrr"))


def gold_coverage(queries: DataFrame, gold: str = "gold") -> DataFrame:
    """One row: queries, those with gold ids, and the average number of ids of these."""
    n = F.size(F.coalesce(F.col(gold), F.array().cast("array<bigint>")))
    return queries.agg(F.count("*").alias("queries"), F.count_if(n > 0).alias("with_gold"), F.avg(F.when(n > 0, n)).alias("average"))


#: What a grade of evidence is worth (fixed values).
EVIDENCE = {"A": 1.0, "B": 0.75, "C": 0.5, "D": 0.3, "F": 0.1}


def safety_evidence(rows: DataFrame, dangerous: Column, grade: Column) -> DataFrame:
    """One row: the rates of dangerous rows and of grades A and F, and the mean worth of the grades."""
    worth = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])
    g = rows.select(dangerous.cast("double").alias("d"), grade.alias("g"))
    return g.agg(F.avg("d").alias("dangerous_rate"), F.avg((F.col("g") == "A").cast("double")).alias("a_rate"), F.avg((F.col("g") == "F").cast("double")).alias("f_rate"), F.avg(F.try_element_at(worth, F.col("g"))).alias("quality"))


def _shown_ideal(gold: Column, shown: Column, k: int) -> Column:
    return _ideal(F.least(gold, shown), k)


def average_precision(judgements: DataFrame) -> DataFrame:
    """(qid, ap): mean over all gold documents of the precision at each hit of the whole list."""
    from pyspark.sql import Window

    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    so_far = judgements.withColumn("n", F.sum("hit").over(w))
    return so_far.groupBy("qid", "gold_n").agg(F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n") / F.col("rank"))), F.lit(0.0)).alias("s")).select("qid", (F.col("s") / F.col("gold_n")).alias("ap"))


def macro(per_query: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, population deviation and median of each metric, a row per metric (and stratum)."""
    long = per_query.unpivot(list(by or []), columns, "metric", "value")
    return long.groupBy(*(by or []), "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"), F.count("value").alias("n"))


def violations(predictions: DataFrame, flagged: DataFrame, k: int) -> DataFrame:
    """(qid, violation, safe): whether any of the first k documents is flagged."""
    bad = predictions.filter(F.col("rank") <= k).join(flagged.select("doc_id").distinct().withColumn("bad", F.lit(1)), "doc_id", "left")
    v = F.max(F.coalesce("bad", F.lit(0)))
    return bad.groupBy("qid").agg(v.alias("violation"), (1 - v).alias("safe"))


def alpha_sweep(judged_by_alpha: DataFrame, k: int) -> DataFrame:
    """Best alpha by (mean nDCG, mean recall) from rows (alpha, qid, gold_n, rank, hit): all alphas with ``best`` marked."""
    from pyspark.sql import Window

    top = F.col("rank") <= k
    q = judged_by_alpha.groupBy("alpha", "qid", "gold_n").agg(F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hits"), F.coalesce(F.sum(F.when(top & (F.col("hit") == 1), 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"))
    a = q.groupBy("alpha").agg(F.avg(F.col("dcg") / _ideal(F.col("gold_n"), k)).alias("ndcg"), F.avg(F.col("hits") / F.col("gold_n")).alias("recall"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.round("ndcg", 9).desc(), F.round("recall", 9).desc(), "alpha")
    return a.withColumn("best", F.row_number().over(order) == 1)


#: Cumulative probabilities of the Poisson distribution with mean 1.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(n + 1)) for n in range(12)]


def paired_bootstrap(pairs: DataFrame, a: str, b: str, rounds: int = 1000, seed: int = 42, key: str = "qid") -> DataFrame:
    """(n, delta, ci_low, ci_high, p_one, p_two, p_tail): mean difference b - a of the pairs, its 95 % percentile interval, one-
    and two-sided p with add-one smoothing, and twice the lesser tail without.

    A pair counts in a round as often as a seeded Poisson draw by hash of round and key says, which is what drawing with
    replacement comes to; the rounds are partial sums of one aggregation, so no pair is shuffled and reruns agree.
    """
    rows = pairs.select(F.col(key).cast("string").alias("k"), (F.col(b) - F.col(a)).alias("d")).dropna()
    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.conv(F.left(F.md5(F.encode(F.concat_ws("-", F.lit(str(seed)), F.col("round").cast("string"), "k"), "UTF-8")), F.lit(8)), 16, 10).cast("double") / 2.0**32
    w = None
    for n, p in enumerate(POISSON):
        w = F.when(F.col("u") < p, n) if w is None else w.when(F.col("u") < p, n)
    means = drawn.withColumn("u", u).withColumn("w", w.otherwise(len(POISSON))).groupBy("round").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("d")).alias("t")).filter("s > 0").select((F.col("t") / F.col("s")).alias("m"))
    got = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.count_if(F.col("m") <= 0).alias("down"), F.count_if(F.col("m") >= 0).alias("up"), F.count("*").alias("r"))
    one = got.withColumn("p_one", (F.col("down") + 1) / (F.col("r") + 1.0)).withColumn("p_tail", F.try_divide(2.0 * F.least("down", "up"), F.col("r")))
    base = rows.agg(F.count("*").alias("n"), F.avg("d").alias("delta"))
    return one.join(F.broadcast(base)).select("n", "delta", F.col("ci")[0].alias("ci_low"), F.col("ci")[1].alias("ci_high"), "p_one", F.least(F.lit(1.0), 2 * F.least("p_one", 1 - F.col("p_one"))).alias("p_two"), "p_tail")
