"""Ranking metrics over predictions and gold: gold are the five best of the other list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..registry import Tables, query
from .retrieval import HITS, one_list

K = 10
JUDGED = f"""{HITS},
gold AS (SELECT qid, doc_id FROM hits WHERE source = 'dense' AND rank <= 5),
gn AS (SELECT qid, count(*) AS gold_n FROM gold GROUP BY 1),
j AS (SELECT gn.qid, gold_n, h.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM gn LEFT JOIN (SELECT * FROM hits WHERE source = 'bm25') h USING (qid) LEFT JOIN gold g ON g.qid = h.qid AND g.doc_id = h.doc_id),
m AS (SELECT qid, gold_n, coalesce(sum(hit) FILTER (WHERE rank <= {K}), 0) AS hits, count(*) FILTER (WHERE rank <= {K}) AS shown,
  coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE hit = 1 AND rank <= {K}), 0) AS dcg, min(rank) FILTER (WHERE hit = 1) AS first, min(rank) FILTER (WHERE hit = 1 AND rank <= {K}) AS first_k FROM j GROUP BY 1, 2)"""
IDEAL = "coalesce(list_sum(list_transform(generate_series(1, CAST({0} AS BIGINT)), lambda i: 1.0 / log2(i + 1.0))), 0)"


def judged(t: Tables) -> DataFrame:
    return evaluate.judged(one_list(t), one_list(t, "dense").filter("rank <= 5"))


def metric(name: str, columns: dict[str, str]):
    """Registers a query of some metric columns: result name -> SQL."""
    sql = f"WITH {JUDGED} SELECT qid, " + ", ".join(f"round({s}, 6) AS {c}" for c, s in columns.items()) + " FROM m"

    @query(name, sql)
    def run(t: Tables, columns=columns) -> DataFrame:
        return evaluate.metrics(judged(t), K).select("qid", *[F.round(c, 6).alias(c) for c in columns])


SAFE = "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END"
metric("precision_at_k", {"precision": f"hits / {K}.0", "precision_shown": SAFE.format("hits", f"least({K}, shown)")})
metric("recall_at_k", {"recall": "hits / gold_n", "recall_capped": "hits / (gold_n + 1e-9)"})
metric("ndcg_std", {"ndcg": f"dcg / {IDEAL.format(f'least(gold_n, {K})')}", "ndcg_floor": f"dcg / {IDEAL.format(f'least(greatest(gold_n, 1), {K})')}"})
metric("ndcg_self_ideal", {"ndcg_self": SAFE.format("dcg", IDEAL.format("hits"))})
metric("ndcg_shown", {"ndcg_shown": f"dcg / ({IDEAL.format(f'least(gold_n, shown, {K})')} + 1e-9)"})
metric("ndcg_unit_ideal", {"ndcg_unit": "dcg"})
metric("mrr", {"rr": "coalesce(1.0 / first, 0)", "rr_k": "coalesce(1.0 / first_k, 0)"})
@query("recall_or_null", f"WITH {JUDGED} SELECT s_suppkey AS qid, CASE WHEN gold_n > 0 AND s_suppkey % 3 > 0 THEN round(hits / gold_n, 6) END AS recall_or_null, CASE WHEN s_suppkey % 3 > 0 THEN round(hits / gold_n, 6) ELSE 0 END AS recall FROM supplier LEFT JOIN m ON qid = s_suppkey WHERE m.qid IS NOT NULL OR s_suppkey % 3 = 0")
def recall_or_null(t: Tables) -> DataFrame:
    return evaluate.metrics(judged_some(t), K).select("qid", F.round("recall_or_null", 6).alias("recall_or_null"), F.round("recall", 6).alias("recall"))


@query("macro_recall_or_null", f"WITH {JUDGED} SELECT 'recall_or_null' AS metric, round(avg(hits / gold_n), 6) AS mean, count(*) AS n FROM m WHERE qid % 3 > 0 UNION ALL SELECT 'recall', round((SELECT sum(hits / gold_n) FROM m WHERE qid % 3 > 0) / count(*), 6), count(*) FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey IN (SELECT qid FROM m)")
def macro_recall_or_null(t: Tables) -> DataFrame:
    return evaluate.macro(evaluate.metrics(judged_some(t), K), ["recall_or_null", "recall"]).select("metric", F.round("mean", 6).alias("mean"), "n")


def judged_some(t: Tables) -> DataFrame:
    """Queries by three have no gold, but are judged."""
    gold = one_list(t, "dense").filter("rank <= 5 and qid % 3 > 0")
    asked = t.supplier.select(F.col("s_suppkey").alias("qid"))
    known = gold.select("qid").unionByName(asked.filter("qid % 3 = 0"))
    return evaluate.judged(one_list(t), gold, known)


AT = {f"{m}@{k}": (m, k) for k in (3, 10) for m in ("precision", "recall", "ndcg")}
PER_K = "SELECT qid, gold_n, {0} AS k, coalesce(sum(hit) FILTER (WHERE rank <= {0}), 0) AS hits, coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE hit = 1 AND rank <= {0}), 0) AS dcg FROM j GROUP BY 1, 2"


def at_sql(m: str, k: int) -> str:
    ideal = IDEAL.format(f"least(k{k}.gold_n, {k})")
    return {"precision": f"k{k}.hits / {k}.0", "recall": f"k{k}.hits / k{k}.gold_n", "ndcg": f"k{k}.dcg / {ideal}"}[m]


@query("metrics_at_ks", f"WITH {JUDGED}, k3 AS ({PER_K.format(3)}), k10 AS ({PER_K.format(10)}) SELECT qid, " + ", ".join(f'round({at_sql(m, k)}, 6) AS "{n}"' for n, (m, k) in AT.items()) + " FROM k3 JOIN k10 USING (qid)")
def metrics_at_ks(t: Tables) -> DataFrame:
    return evaluate.metrics_at(judged(t), [3, 10], ["precision", "recall", "ndcg"]).select("qid", *[F.round(f"`{n}`", 6).alias(n) for n in AT])


def tabled(t: Tables) -> DataFrame:
    """Every supplier is a query; those by three have no gold."""
    gold = one_list(t, "dense").filter("rank <= 5 and qid % 3 > 0")
    return evaluate.per_query(one_list(t), gold, t.supplier.select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("text")), [10])


TABLED = f"""{JUDGED}, p AS (SELECT qid, count(*) AS hits_n FROM hits WHERE source = 'bm25' GROUP BY 1),
e AS (SELECT s_suppkey AS qid, s_name AS text, CASE WHEN s_suppkey % 3 > 0 THEN coalesce(gold_n, 0) ELSE 0 END AS gold_n, coalesce(hits_n, 0) AS hits_n, CASE WHEN s_suppkey % 3 > 0 THEN coalesce(first, 0) ELSE 0 END AS first_hit_rank,
  CASE WHEN s_suppkey % 3 > 0 THEN coalesce(hits / gold_n, 0) ELSE 0 END AS recall, CASE WHEN s_suppkey % 3 > 0 THEN coalesce(hits / {K}.0, 0) ELSE 0 END AS prec, CASE WHEN s_suppkey % 3 > 0 THEN coalesce(dcg / {IDEAL.format(f"least(gold_n, {K})")}, 0) ELSE 0 END AS ndcg
  FROM supplier LEFT JOIN m ON m.qid = s_suppkey LEFT JOIN p ON p.qid = s_suppkey)"""


@query("per_query_table", f'WITH {TABLED} SELECT qid, text, gold_n, hits_n, CAST(first_hit_rank AS INTEGER) AS first_hit_rank, round(CASE WHEN first_hit_rank > 0 THEN 1.0 / first_hit_rank ELSE 0 END, 6) AS mrr, round(recall, 6) AS "recall@10", round(prec, 6) AS "precision@10", round(ndcg, 6) AS "ndcg@10", CAST(0 AS DOUBLE) AS "must_avoid@10" FROM e')
def per_query_table(t: Tables) -> DataFrame:
    df = tabled(t)
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


@query("per_query_summary", f'WITH {TABLED} SELECT count(*) AS queries, count(*) FILTER (WHERE gold_n > 0) AS with_gold, count(*) FILTER (WHERE gold_n > 0 AND first_hit_rank = 0) AS misses, round(avg(CASE WHEN first_hit_rank > 0 THEN 1.0 / first_hit_rank ELSE 0 END) FILTER (WHERE gold_n > 0), 6) AS mrr, round(avg(recall) FILTER (WHERE gold_n > 0), 6) AS "recall@10", round(avg(prec) FILTER (WHERE gold_n > 0), 6) AS "precision@10", round(avg(ndcg) FILTER (WHERE gold_n > 0), 6) AS "ndcg@10" FROM e')
def per_query_summary(t: Tables) -> DataFrame:
    df = evaluate.per_query_summary(tabled(t), [10])
    return df.select(*[F.round(f"`{c}`", 6).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


@query(
    "eval_harness",
    f"""WITH {TABLED}, x AS (SELECT qid, ndcg, CASE WHEN gold_n > 0 THEN (SELECT count(*) FROM j WHERE j.qid = e.qid AND hit = 1 AND rank <= 20) / gold_n ELSE 0 END AS r, CASE WHEN first_hit_rank > 0 THEN 1.0 / first_hit_rank ELSE 0 END AS rr FROM e),
s AS (SELECT qid, unnest(list_filter(['all', CASE WHEN qid % 2 = 0 THEN 'even' END, CASE WHEN qid % 5 = 0 THEN 'fifth' END], lambda a: a IS NOT NULL)) AS subset FROM x)
SELECT subset, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(r), 6) AS recall, round(avg(rr), 6) AS mrr FROM s JOIN x USING (qid) GROUP BY 1""",
)
def eval_harness(t: Tables) -> DataFrame:
    gold = one_list(t, "dense").filter("rank <= 5 and qid % 3 > 0")
    queries = t.supplier.select(F.col("s_suppkey").alias("qid"))
    out = evaluate.harness(one_list(t), gold, queries, {"even": F.col("qid") % 2 == 0, "fifth": F.col("qid") % 5 == 0, "never": F.lit(False)}, 10, 20)
    return out.select("subset", "queries", *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")])


@query("gold_coverage", f"WITH {HITS}, g AS (SELECT qid, count(*) AS n FROM hits JOIN part ON p_partkey = doc_id WHERE source = 'dense' AND rank <= 3 AND p_size > 25 GROUP BY 1) SELECT count(*) AS queries, count(n) AS with_gold, round(avg(n), 6) AS average FROM supplier LEFT JOIN g ON qid = s_suppkey")
def gold_coverage(t: Tables) -> DataFrame:
    g = one_list(t, "dense").filter("rank <= 3").join(t.part.filter("p_size > 25").select(F.col("p_partkey").alias("doc_id")), "doc_id").groupBy("qid").agg(F.collect_list("doc_id").alias("gold"))
    rows = t.supplier.select(F.col("s_suppkey").alias("qid")).join(g, "qid", "left")
    return evaluate.gold_coverage(rows).withColumn("average", F.round("average", 6))


@query("run_metadata", f"WITH {HITS} SELECT 'run-1' AS run_id, count(DISTINCT qid) AS queries, count(*) AS rows, 'k=20;list=bm25' AS params FROM hits WHERE source = 'bm25'")
def run_metadata(t: Tables) -> DataFrame:
    from ..operators import trace

    m = trace.run_metadata(one_list(t), "run-1", {"k": "20", "list": "bm25"})
    return m.select("run_id", "queries", "rows", F.array_join(F.transform(F.map_entries("params"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("params"))


metric("f1_hit", {"f1": f"CASE WHEN hits > 0 THEN 2 * (hits / {K}.0) * (hits / gold_n) / (hits / {K}.0 + hits / gold_n) ELSE 0 END", "hit": "CAST(CASE WHEN hits > 0 THEN 1 ELSE 0 END AS DOUBLE)"})


@query(
    "average_precision",
    f"WITH {JUDGED}, n AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS n FROM j) SELECT qid, round(coalesce(sum(n / rank) FILTER (WHERE hit = 1), 0) / gold_n, 6) AS ap FROM n GROUP BY qid, gold_n",
)
def average_precision(t: Tables) -> DataFrame:
    return evaluate.average_precision(judged(t)).select("qid", F.round("ap", 6).alias("ap"))


LONG = "long AS (SELECT qid, 'precision' AS metric, hits / 10.0 AS value FROM m UNION ALL SELECT qid, 'recall', hits / gold_n FROM m UNION ALL SELECT qid, 'ndcg', dcg / {0} FROM m)".format(IDEAL.format(f"least(gold_n, {K})"))
STATS = "round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(median(value), 6) AS median, count(value) AS n"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "metric", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median")], "n")


@query("macro_metrics", f"WITH {JUDGED}, {LONG} SELECT metric, {STATS} FROM long GROUP BY metric")
def macro_metrics(t: Tables) -> DataFrame:
    return rounded(evaluate.macro(evaluate.metrics(judged(t), K), ["precision", "recall", "ndcg"]))


@query("stratified_metrics", f"WITH {JUDGED}, {LONG} SELECT CAST(s_nationkey AS VARCHAR) AS stratum, metric, {STATS} FROM long JOIN supplier ON s_suppkey = qid GROUP BY 1, 2")
def stratified_metrics(t: Tables) -> DataFrame:
    rows = evaluate.metrics(judged(t), K).join(t.supplier.select(F.col("s_suppkey").alias("qid"), F.col("s_nationkey").cast("string").alias("stratum")), "qid")
    return rounded(evaluate.macro(rows, ["precision", "recall", "ndcg"], ["stratum"]), "stratum")


@query(
    "safe_violation",
    f"WITH {HITS}, p AS (SELECT * FROM hits WHERE source = 'bm25' AND rank <= {K}), b AS (SELECT p_partkey FROM part WHERE p_size <= 3) SELECT qid, CAST(max(CASE WHEN doc_id IN (SELECT p_partkey FROM b) THEN 1 ELSE 0 END) AS INTEGER) AS violation, CAST(1 - max(CASE WHEN doc_id IN (SELECT p_partkey FROM b) THEN 1 ELSE 0 END) AS INTEGER) AS safe FROM p GROUP BY 1",
)
def safe_violation(t: Tables) -> DataFrame:
    return evaluate.violations(one_list(t), t.part.filter("p_size <= 3").select(F.col("p_partkey").alias("doc_id")), K)


@query(
    "safety_evidence",
    """WITH e AS (SELECT l.doc_id, toxic, CASE doc_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'F' END AS g FROM labels l)
SELECT round(avg(toxic), 6) AS dangerous_rate, round(avg(CASE WHEN g = 'A' THEN 1.0 ELSE 0 END), 6) AS a_rate, round(avg(CASE WHEN g = 'F' THEN 1.0 ELSE 0 END), 6) AS f_rate, round(avg(CASE g WHEN 'A' THEN 1 WHEN 'B' THEN 0.75 WHEN 'C' THEN 0.5 WHEN 'D' THEN 0.3 ELSE 0.1 END), 6) AS quality FROM e""",
)
def safety_evidence(t: Tables) -> DataFrame:
    g = F.element_at(F.array(*[F.lit(x) for x in "ABCDF"]), (F.col("doc_id") % 5 + 1).cast("int"))
    out = evaluate.safety_evidence(t.labels, F.col("toxic") == 1, g)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "alpha_sweep",
    f"""WITH {HITS}, gold AS (SELECT qid, doc_id FROM hits WHERE source = 'dense' AND rank <= 5), gn AS (SELECT qid, count(*) AS gold_n FROM gold GROUP BY 1),
a AS (SELECT unnest([10, 60, 120]) AS alpha), f AS (SELECT alpha, qid, doc_id, sum(CASE source WHEN 'bm25' THEN 2.0 ELSE 1.0 END / (alpha + rank)) AS score FROM hits, a GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f),
j AS (SELECT r.alpha, r.qid, gold_n, r.rank, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS hit FROM r JOIN gn USING (qid) LEFT JOIN gold g ON g.qid = r.qid AND g.doc_id = r.doc_id),
q AS (SELECT alpha, qid, gold_n, sum(CASE WHEN rank <= {K} THEN hit ELSE 0 END) AS hits, coalesce(sum(1.0 / log2(rank + 1.0)) FILTER (WHERE hit = 1 AND rank <= {K}), 0) AS dcg FROM j GROUP BY 1, 2, 3),
s AS (SELECT alpha, avg(dcg / {IDEAL.format(f"least(gold_n, {K})")}) AS ndcg, avg(hits / gold_n) AS recall FROM q GROUP BY 1)
SELECT alpha, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, row_number() OVER (ORDER BY round(ndcg, 9) DESC, round(recall, 9) DESC, alpha) = 1 AS best FROM s""",
)
def alpha_sweep(t: Tables) -> DataFrame:
    from ..operators import scores
    from .retrieval import hits

    rows = hits(t).withColumn("alpha", F.explode(F.array(F.lit(10), F.lit(60), F.lit(120))))
    w = F.when(F.col("source") == "bm25", 2.0).otherwise(1.0)
    f = scores.ranked(rows.groupBy("alpha", "qid", "doc_id").agg(F.sum(w / (F.col("alpha") + F.col("rank"))).alias("score")), ["alpha", "qid"])
    gold = one_list(t, "dense").filter("rank <= 5").select("qid", "doc_id").withColumn("hit", F.lit(1))
    sizes = gold.groupBy("qid").agg(F.count("*").alias("gold_n"))
    j = f.join(sizes, "qid").join(gold, ["qid", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return evaluate.alpha_sweep(j, K).select("alpha", F.round("ndcg", 6).alias("ndcg"), F.round("recall", 6).alias("recall"), "best")


POISSON_SQL = "CASE " + " ".join(f"WHEN u < {p!r} THEN {n}" for n, p in enumerate(evaluate.POISSON)) + f" ELSE {len(evaluate.POISSON)} END"


@query(
    "paired_bootstrap",
    f"""WITH {JUDGED}, o AS (SELECT qid, sum(1.0 / log2(21 - rank + 1.0)) FILTER (WHERE 21 - rank <= {K} AND rank <= 5) AS dcg FROM hits WHERE source = 'dense' GROUP BY 1),
d AS (SELECT m.qid, coalesce(o.dcg, 0) / {IDEAL.format(f"least(gold_n, {K})")} - m.dcg / {IDEAL.format(f"least(gold_n, {K})")} AS d FROM m JOIN o USING (qid)),
w AS (SELECT r, d, ('0x' || left(md5('42-' || r || '-' || qid), 8))::BIGINT / 4294967296.0 AS u FROM d, (SELECT unnest(range(1, 201)) AS r)),
b AS (SELECT sum(d * k) / sum(k) AS m FROM (SELECT r, d, {POISSON_SQL} AS k FROM w) GROUP BY r HAVING sum(k) > 0),
p AS (SELECT quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, (count(*) FILTER (WHERE m <= 0) + 1) / (count(*) + 1.0) AS p, 2 * least(count(*) FILTER (WHERE m <= 0), count(*) FILTER (WHERE m >= 0)) / count(*) AS tail FROM b)
SELECT (SELECT count(*) FROM d) AS n, (SELECT round(avg(d), 6) FROM d) AS delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(p, 6) AS p_one, round(least(1.0, 2 * least(p, 1 - p)), 6) AS p_two, round(tail, 6) AS p_tail FROM p""",
)
def paired_bootstrap(t: Tables) -> DataFrame:
    m = evaluate.metrics(judged(t), K)
    other = evaluate.metrics(evaluate.judged(one_list(t, "dense").withColumn("rank", 21 - F.col("rank")), one_list(t, "dense").filter("rank <= 5")), K)
    pairs = m.select("qid", F.col("ndcg").alias("a")).join(other.select("qid", F.col("ndcg").alias("b")), "qid")
    out = evaluate.paired_bootstrap(pairs, "a", "b", 200)
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "self_retrieval",
    """WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
o AS (SELECT * FROM s WHERE qid = doc_id)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_10 FROM o""",
)
def self_retrieval(t: Tables) -> DataFrame:
    from ..operators import dense

    asked = t.embeddings.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    top = dense.dense_top(t.embeddings, asked, 10).filter("qid = doc_id").select("qid", "rank")
    rows = asked.select("qid").join(top, "qid", "left")
    at = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")
    return rows.agg(F.count("*").alias("n"), at(1), at(5), at(10))
