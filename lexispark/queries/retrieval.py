"""Retrieval, fusion, boosting, gates and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Bm25Config, FusionConfig, GatePolicy, SearchConfig
from ..functions.text import TOKEN
from ..operators import clinical, dense, filters, fusion, lexical, rerank, scores, trace
from ..plans.search import search
from ..registry import Tables, query

#: Tokens of a column in DuckDB.
TOK = f"regexp_extract_all(lower(coalesce({{0}}, '')), '{TOKEN}')"


def bm25_sql(k1: float, top: int, repeat: bool, digits: int | None = 6) -> str:
    """The scorer in plain SQL."""
    return f"""
WITH d AS (SELECT doc_id, {TOK.format("text")} AS w FROM documents),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(w)) AS avgdl FROM d),
q AS (SELECT qid, term, {"count(*)" if repeat else "1"} AS qtf FROM (SELECT item_id AS qid, unnest({TOK.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT q.qid, p.doc_id, sum(q.qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * len(d.w) / avgdl) + 1e-9)) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN d ON d.doc_id = p.doc_id, st GROUP BY 1, 2),
r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT qid, doc_id, {f"round(score, {digits})" if digits else "score"} AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= {top}"""


def shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *more)


@query("bm25_topk", bm25_sql(1.5, 10, True))
def bm25_topk(t: Tables) -> DataFrame:
    return shown(lexical.bm25_top(t.documents, t.benchmark, 10))


@query("bm25_dedup_terms", bm25_sql(1.2, 10, False))
def bm25_dedup_terms(t: Tables) -> DataFrame:
    return shown(lexical.bm25_top(t.documents, t.benchmark, 10, Bm25Config(k1=1.2, repeat_terms=False)))


@query(
    "dense_topk",
    """
WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10""",
)
def dense_topk(t: Tables) -> DataFrame:
    asked = t.embeddings.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    return shown(dense.dense_top(t.embeddings, asked, 10))


@query(
    "mean_pool_l2",
    """
WITH m AS (SELECT label AS key, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2),
l AS (SELECT key, sqrt(sum(mean * mean)) AS len FROM m GROUP BY 1)
SELECT CAST(key AS BIGINT) AS key, CAST(pos AS BIGINT) AS pos, round(mean / len, 6) AS value FROM m JOIN l USING (key)""",
)
def mean_pool_l2(t: Tables) -> DataFrame:
    return dense.mean_pool(t.embeddings, "label", "embedding").select(F.col("key").cast("long").alias("key"), F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


#: Two ranked lists for each supplier: parts by quantity returned and by quantity accepted.
HITS = """
base AS (SELECT l_suppkey AS qid, CASE l_returnflag WHEN 'R' THEN 'bm25' ELSE 'dense' END AS source, l_partkey AS doc_id, sum(l_quantity) AS score
  FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2, 3),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY round(score, 6) DESC, doc_id) AS rank FROM base) WHERE rank <= 20)"""


def hits(t: Tables) -> DataFrame:
    rows = t.lineitem.filter(F.col("l_returnflag").isin("R", "A"))
    rows = rows.groupBy(F.col("l_suppkey").alias("qid"), F.when(F.col("l_returnflag") == "R", "bm25").otherwise("dense").alias("source"), F.col("l_partkey").alias("doc_id")).agg(F.sum("l_quantity").alias("score"))
    return scores.top_k(rows, ["qid", "source"], 20)


def one_list(t: Tables, source: str = "bm25") -> DataFrame:
    return hits(t).filter(F.col("source") == source).drop("source")


RANKED = "row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id)"
FINAL = f"SELECT qid, doc_id, round(score, 6) AS score, CAST({RANKED} AS BIGINT) AS rank FROM f"


@query("rrf", f"WITH {HITS}, f AS (SELECT qid, doc_id, sum(1.0 / (60 + rank)) AS score FROM hits GROUP BY 1, 2) {FINAL}")
def rrf(t: Tables) -> DataFrame:
    return shown(fusion.fuse(hits(t), FusionConfig("rrf")))


@query("weighted_rrf", f"WITH {HITS}, f AS (SELECT qid, doc_id, sum(CASE source WHEN 'bm25' THEN 2.0 ELSE 1.0 END / (90 + rank)) AS score FROM hits GROUP BY 1, 2) {FINAL}")
def weighted_rrf(t: Tables) -> DataFrame:
    return shown(fusion.fuse(hits(t), FusionConfig("wrrf", {"bm25": 2.0, "dense": 1.0}, 90)))


SCALED = "scaled AS (SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w > 1e-12 THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0.5 END AS s FROM hits WINDOW w AS (PARTITION BY qid, source))"


@query("minmax_weighted", f"WITH {HITS}, {SCALED}, f AS (SELECT qid, doc_id, sum(CASE source WHEN 'bm25' THEN 0.55 ELSE 0.45 END * s) AS score FROM scaled GROUP BY 1, 2) {FINAL}")
def minmax_weighted(t: Tables) -> DataFrame:
    return shown(fusion.fuse(hits(t)))


@query(
    "minmax_union",
    f"""WITH {HITS}, u AS (SELECT qid, doc_id, coalesce(max(CASE source WHEN 'bm25' THEN score END), 0) AS a, coalesce(max(CASE source WHEN 'dense' THEN score END), 0) AS b FROM hits GROUP BY 1, 2),
n AS (SELECT *, CASE WHEN max(a) OVER w - min(a) OVER w > 1e-12 THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END AS x,
  CASE WHEN max(b) OVER w - min(b) OVER w > 1e-12 THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END AS y FROM u WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, doc_id, 0.45 * x + 0.55 * y AS score FROM n) {FINAL}""",
)
def minmax_union(t: Tables) -> DataFrame:
    return shown(fusion.fuse(hits(t), FusionConfig("minmax_union", {"bm25": 0.45, "dense": 0.55})))


@query(
    "softmax_norm",
    f"WITH {HITS}, e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY qid, source)) / 20.0) AS e FROM hits) SELECT qid, source, doc_id, round(e / sum(e) OVER (PARTITION BY qid, source), 6) AS p, round(score / max(score) OVER (PARTITION BY qid, source), 6) AS m FROM e",
)
def softmax_norm(t: Tables) -> DataFrame:
    df = scores.over_max(scores.softmax(hits(t), ["qid", "source"], "score", "p", 20.0), ["qid", "source"], "score", "m")
    return df.select("qid", "source", "doc_id", F.round("p", 6).alias("p"), F.round("m", 6).alias("m"))


@query(
    "dedup_best",
    f"WITH {HITS}, k AS (SELECT h.*, p.p_brand AS brand, row_number() OVER (PARTITION BY qid, source, p.p_brand ORDER BY rank) AS n FROM hits h JOIN part p ON p.p_partkey = h.doc_id) SELECT qid, source, brand, doc_id, CAST(rank AS BIGINT) AS rank FROM k WHERE n = 1",
)
def dedup_best(t: Tables) -> DataFrame:
    rows = hits(t).join(t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("brand")), "doc_id")
    return scores.keep_first(rows, ["qid", "source", "brand"], [F.col("rank")]).select("qid", "source", "brand", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    "passage_to_doc",
    """
WITH p AS (SELECT l_suppkey AS qid, l_partkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem),
d AS (SELECT qid, doc_id, min(rank) AS first_rank FROM p GROUP BY 1, 2)
SELECT qid, doc_id, CAST(first_rank AS BIGINT) AS first_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_rank, doc_id) AS BIGINT) AS rank FROM d""",
)
def passage_to_doc(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = t.lineitem.select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.row_number().over(w).alias("rank"))
    return scores.passages_to_docs(rows).select("qid", "doc_id", F.col("first_rank").cast("long").alias("first_rank"), F.col("rank").cast("long").alias("rank"))


@query(
    "union_boost",
    f"""WITH {HITS}, {SCALED}, m AS (SELECT qid, doc_id, sum(CASE source WHEN 'bm25' THEN 0.55 ELSE 0.45 END * s) AS score FROM scaled GROUP BY 1, 2),
u AS (SELECT DISTINCT s.s_suppkey AS qid, p.p_partkey AS doc_id FROM supplier s, part p WHERE p.p_partkey = s.s_suppkey OR p.p_partkey = s.s_suppkey + 1),
f AS (SELECT qid, doc_id, sum(score) AS score FROM (SELECT qid, doc_id, score FROM m UNION ALL SELECT qid, doc_id, 0.05 FROM u) GROUP BY 1, 2) {FINAL}""",
)
def union_boost(t: Tables) -> DataFrame:
    pairs = t.supplier.select(F.col("s_suppkey").alias("qid"), F.explode(F.array(F.col("s_suppkey"), F.col("s_suppkey") + 1)).alias("doc_id"))
    pairs = pairs.join(t.part.select(F.col("p_partkey").alias("doc_id")), "doc_id", "left_semi")
    return shown(scores.ranked(fusion.union_boost(fusion.weighted_min_max(hits(t), {"bm25": 0.55, "dense": 0.45}), pairs), ["qid"]))


@query(
    "union_strength",
    f"""WITH {HITS}, {SCALED}, m AS (SELECT qid, doc_id, sum(CASE source WHEN 'bm25' THEN 0.55 ELSE 0.45 END * s) AS score FROM scaled GROUP BY 1, 2),
u AS (SELECT l_suppkey AS qid, l_partkey AS doc_id, max(l_discount) AS strength FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY strength DESC, doc_id) AS n FROM u),
f AS (SELECT qid, doc_id, max(score) AS score FROM (SELECT qid, doc_id, score FROM m UNION ALL SELECT qid, doc_id, 0.05 + 0.15 * strength FROM c WHERE n <= 30) GROUP BY 1, 2) {FINAL}""",
)
def union_strength(t: Tables) -> DataFrame:
    u = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_discount").alias("strength"))
    return shown(scores.ranked(fusion.union_strength(fusion.weighted_min_max(hits(t), {"bm25": 0.55, "dense": 0.45}), u, most=30), ["qid"]))


@query(
    "union_cap",
    f"""WITH {HITS}, u AS (SELECT l_suppkey AS qid, l_partkey AS doc_id, min(l_linenumber) AS ord FROM lineitem GROUP BY 1, 2),
g AS (SELECT * FROM u WHERE (qid, doc_id) IN (SELECT qid, doc_id FROM hits WHERE source = 'bm25')),
r AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY ord, doc_id) AS position FROM g)
SELECT qid, doc_id, CAST(position AS BIGINT) AS position FROM r WHERE position <= 8""",
)
def union_cap(t: Tables) -> DataFrame:
    u = t.lineitem.select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("ord"))
    return fusion.union_cap(u, ["ord"], 8, one_list(t)).select("qid", "doc_id", F.col("position").cast("long").alias("position"))


@query(
    "force_include_union",
    f"""WITH {HITS}, b AS (SELECT qid, doc_id, 0 AS part, rank AS pos FROM hits WHERE source = 'bm25' UNION ALL SELECT qid, doc_id, 1, rank FROM hits WHERE source = 'dense' AND rank <= 5),
o AS (SELECT qid, doc_id, min(part * 1000 + pos) AS o FROM b GROUP BY 1, 2)
SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY o, doc_id) AS BIGINT) AS rank FROM o""",
)
def force_include_union(t: Tables) -> DataFrame:
    extra = one_list(t, "dense").filter("rank <= 5").withColumnRenamed("rank", "position")
    return fusion.force_include(one_list(t), extra).withColumn("rank", F.col("rank").cast("long"))


GATE = f"{HITS}, g AS (SELECT h.qid, h.doc_id, h.score, h.rank, p.p_brand AS section, lower(trim(p.p_brand)) IN (SELECT lower(p_brand) FROM (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 8)) AS good FROM hits h JOIN part p ON p.p_partkey = h.doc_id WHERE h.source = 'bm25')"


def gated(t: Tables, mode: str) -> DataFrame:
    names = tuple(r.p_brand for r in t.part.select("p_brand").distinct().orderBy("p_brand").limit(8).collect())
    rows = one_list(t).join(t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("section")), "doc_id")
    return shown(filters.section_gate(rows, GatePolicy(mode, names)), "section")


@query("section_require", f"WITH {GATE} SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS rank, section FROM g WHERE good")
def section_require(t: Tables) -> DataFrame:
    return gated(t, "require")


@query("section_prefer_order", f"WITH {GATE} SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN good THEN 0 ELSE 1 END, rank) AS BIGINT) AS rank, section FROM g")
def section_prefer_order(t: Tables) -> DataFrame:
    return gated(t, "prefer_order")


@query(
    "section_prefer_score",
    f"WITH {GATE}, s AS (SELECT qid, doc_id, score * CASE WHEN good THEN 1.10 ELSE 1.0 END AS score, section FROM g) SELECT qid, doc_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS BIGINT) AS rank, section FROM s",
)
def section_prefer_score(t: Tables) -> DataFrame:
    return gated(t, "prefer_score")


@query("doc_prefilter", f"WITH {HITS} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM hits WHERE source = 'bm25' AND (qid, doc_id) IN (SELECT qid, doc_id FROM hits WHERE source = 'dense' AND rank <= 15)")
def doc_prefilter(t: Tables) -> DataFrame:
    return shown(filters.doc_prefilter(one_list(t), one_list(t, "dense").filter("rank <= 15")))


@query(
    "filter_with_fallback",
    f"""WITH {HITS}, k AS (SELECT h.*, p.p_size > 25 AS keep FROM hits h JOIN part p ON p.p_partkey = h.doc_id WHERE source = 'bm25'),
n AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY qid) AS kept FROM k)
SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM n WHERE kept < 10 OR keep""",
)
def filter_with_fallback(t: Tables) -> DataFrame:
    rows = one_list(t).join(t.part.select(F.col("p_partkey").alias("doc_id"), "p_size"), "doc_id")
    return shown(filters.with_fallback(rows, F.col("p_size") > 25, 10))


CE = f"{HITS}, c AS (SELECT h.qid, h.doc_id, h.score, h.rank, p.p_size / 50.0 AS ce FROM hits h JOIN part p ON p.p_partkey = h.doc_id WHERE source = 'bm25')"
SCALE = "CASE WHEN max({0}) OVER w - min({0}) OVER w > 1e-12 THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0 END"


def with_ce(t: Tables) -> DataFrame:
    return one_list(t).join(t.part.select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") / 50.0).alias("ce")), "doc_id")


@query("ce_blend_minmax", f"WITH {CE}, x AS (SELECT *, greatest(0, ce - 0.2) AS k FROM c) SELECT qid, doc_id, round(0.4 * {SCALE.format('score')} + 0.6 * {SCALE.format('k')}, 6) AS blended FROM x WINDOW w AS (PARTITION BY qid)")
def ce_blend_minmax(t: Tables) -> DataFrame:
    return rerank.blend_min_max(with_ce(t), 0.6, 0.2).select("qid", "doc_id", F.round("blended", 6).alias("blended"))


@query("ce_blend_clip", f"WITH {CE} SELECT qid, doc_id, round(0.4 * score + 0.6 * greatest(0, ce - 0.2), 6) AS blended FROM c")
def ce_blend_clip(t: Tables) -> DataFrame:
    return rerank.blend_plain(with_ce(t), 0.6, 0.2).select("qid", "doc_id", F.round("blended", 6).alias("blended"))


@query("head_tail", f"WITH {CE} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 8 THEN 0 ELSE 1 END, CASE WHEN rank <= 8 THEN round(ce, 6) END DESC, CASE WHEN rank <= 8 THEN doc_id END, rank) AS BIGINT) AS new_rank FROM c")
def head_tail(t: Tables) -> DataFrame:
    return rerank.head_then_tail(with_ce(t), 8, "ce").select("qid", "doc_id", F.col("new_rank").cast("long").alias("new_rank"))


JUDGE = "j AS (SELECT qid, doc_id, CAST((doc_id * 7 + qid) % 11 AS DOUBLE) AS llm_score, CASE (doc_id + qid) % 5 WHEN 0 THEN 'contraindicated' WHEN 1 THEN 'caution' ELSE 'ok' END AS safety FROM c WHERE rank <= 12)"


def judge(rows: DataFrame) -> DataFrame:
    kind = (F.col("doc_id") + F.col("qid")) % 5
    return rows.filter("rank <= 12").select("qid", "doc_id", ((F.col("doc_id") * 7 + F.col("qid")) % 11).cast("double").alias("llm_score"), F.when(kind == 0, "contraindicated").when(kind == 1, "caution").otherwise("ok").alias("safety"))


@query(
    "llm_adaptive",
    f"""WITH {CE}, {JUDGE}, a AS (SELECT c.qid, c.doc_id, c.ce, llm_score, safety, llm_score / 10 AS g, greatest(0, least(1, c.ce)) AS k FROM c LEFT JOIN j USING (qid, doc_id)),
f AS (SELECT qid, doc_id, CASE WHEN llm_score IS NULL THEN ce WHEN safety = 'contraindicated' THEN 0 WHEN llm_score < 3 THEN 0.3 * g WHEN llm_score >= 8 THEN 0.8 * g + 0.2 * k WHEN llm_score >= 5 THEN 0.6 * g + 0.4 * k ELSE 0.3 * g + 0.7 * k END AS score FROM a) {FINAL}""",
)
def llm_adaptive(t: Tables) -> DataFrame:
    rows = with_ce(t)
    return shown(rerank.adaptive(rows.drop("rank"), judge(rows)).withColumn("score", F.col("final")))


@query(
    "llm_select_backfill",
    f"""WITH {CE}, {JUDGE}, s AS (SELECT qid, doc_id, safety, row_number() OVER (PARTITION BY qid ORDER BY llm_score DESC, doc_id) AS position FROM j WHERE llm_score >= 6),
p AS (SELECT c.qid, c.doc_id, c.ce, safety, row_number() OVER (PARTITION BY c.qid ORDER BY CASE WHEN position IS NULL THEN 1 ELSE 0 END, position, round(ce, 6) DESC, c.doc_id) AS place FROM c LEFT JOIN s USING (qid, doc_id))
SELECT qid, doc_id, CAST(place AS BIGINT) AS place, round((0.65 * (1 - (place - 1) / 10.0) + 0.35 * ce) * CASE safety WHEN 'contraindicated' THEN 0.25 WHEN 'caution' THEN 0.75 ELSE 1 END, 6) AS final FROM p WHERE place <= 10""",
)
def llm_select_backfill(t: Tables) -> DataFrame:
    rows = with_ce(t)
    picked = scores.ranked(judge(rows).filter("llm_score >= 6"), ["qid"], "llm_score", out="position").select("qid", "doc_id", "safety", "position")
    return rerank.select_and_backfill(rows.drop("rank"), picked, 10).select("qid", "doc_id", F.col("place").cast("long").alias("place"), F.round("final", 6).alias("final"))


@query(
    "overlap_scorer",
    f"""WITH q AS (SELECT item_id AS qid, list_distinct({TOK.format("text")}) AS q FROM benchmark),
d AS (SELECT doc_id, list_distinct({TOK.format("text")}) AS w FROM documents)
SELECT qid, doc_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0 END, 6) AS ce FROM q JOIN d ON qid = doc_id % 41""",
)
def overlap_scorer(t: Tables) -> DataFrame:
    pairs = t.documents.select("doc_id", F.col("text").alias("d"), (F.col("doc_id") % 41).alias("qid"))
    pairs = pairs.join(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("q")), "qid")
    return rerank.overlap(pairs, "q", "d").select("qid", "doc_id", F.round("ce", 6).alias("ce"))


@query(
    "cross_encoder_scores",
    f"WITH {HITS} SELECT qid, doc_id, round(length(s_name) / CAST(length(p_name) AS DOUBLE), 6) AS ce FROM hits JOIN part ON p_partkey = doc_id JOIN supplier ON s_suppkey = qid WHERE source = 'bm25'",
)
def cross_encoder_scores(t: Tables) -> DataFrame:
    """Any model's score of (query, text) pairs: here one that divides their lengths."""
    pairs = one_list(t).join(t.part.select(F.col("p_partkey").alias("doc_id"), "p_name"), "doc_id").join(t.supplier.select(F.col("s_suppkey").alias("qid"), "s_name"), "qid")
    return rerank.scored_by(pairs, lambda: lambda q, d: q.str.len() / d.str.len(), "s_name", "p_name").select("qid", "doc_id", F.round("ce", 6).alias("ce"))


@query(
    "ce_blend_head",
    f"WITH {CE}, x AS (SELECT * FROM c WHERE rank <= 8), y AS (SELECT qid, doc_id, 0.7 * {SCALE.format('score')} + 0.3 * {SCALE.format('ce')} AS blended FROM x WINDOW w AS (PARTITION BY qid)) SELECT qid, doc_id, round(blended, 6) AS blended FROM y UNION ALL SELECT qid, doc_id, round(score, 6) FROM c WHERE rank > 8",
)
def ce_blend_head(t: Tables) -> DataFrame:
    return rerank.blend_head(with_ce(t), 8, 0.3).select("qid", "doc_id", F.round("blended", 6).alias("blended"))


@query("ce_replaces_score", f"WITH {CE}, f AS (SELECT qid, doc_id, ce AS score FROM c WHERE rank <= 8), r AS ({FINAL}) SELECT * FROM r WHERE rank <= 5")
def ce_replaces_score(t: Tables) -> DataFrame:
    return shown(rerank.replaced_by_ce(with_ce(t), 8, 5))


@query("two_key_sort", f"WITH {CE} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(ce, 6) DESC, round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM c")
def two_key_sort(t: Tables) -> DataFrame:
    return rerank.by_two_keys(with_ce(t), "ce", "score").select("qid", "doc_id", "rank")


@query("candidate_pool", f"WITH {HITS} SELECT qid, doc_id, CAST(rank AS BIGINT) AS rank FROM hits WHERE source = 'bm25' AND rank <= 12")
def candidate_pool(t: Tables) -> DataFrame:
    return one_list(t).filter(F.col("rank") <= rerank.pool_size(3, 2, 1)).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("hits_in_corpus", f"WITH {HITS} SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS rank FROM hits WHERE source = 'bm25' AND doc_id IN (SELECT p_partkey FROM part WHERE p_size > 20)")
def hits_in_corpus(t: Tables) -> DataFrame:
    docs = t.part.filter("p_size > 20").select(F.col("p_partkey").alias("doc_id"))
    return filters.in_corpus(one_list(t), docs).select("qid", "doc_id", F.col("rank").cast("long").alias("rank"))


@query(
    "doc_prefilter_lists",
    f"WITH {HITS}, d AS (SELECT DISTINCT l_suppkey AS qid, l_partkey AS doc_id FROM lineitem WHERE l_returnflag = 'N') SELECT source, qid, doc_id, CAST(rank AS BIGINT) AS rank FROM hits WHERE source <> 'bm25' OR (qid, doc_id) IN (SELECT qid, doc_id FROM d)",
)
def doc_prefilter_lists(t: Tables) -> DataFrame:
    top = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_suppkey").alias("qid"), F.col("l_partkey").alias("doc_id"))
    return filters.doc_prefilter(hits(t), top, ["bm25"]).select("source", "qid", "doc_id", F.col("rank").cast("long").alias("rank"))


#: Phrases that documents share: the first five words of every benchmark item.
PHRASES = f"phrases AS (SELECT DISTINCT array_to_string({TOK.format('text')}[1:5], ' ') AS phrase FROM benchmark)"


@query(
    "phrase_and_postings",
    f"""WITH {PHRASES}, d AS (SELECT doc_id, ' ' || array_to_string({TOK.format("text")}, ' ') || ' ' AS s FROM documents)
SELECT phrase, doc_id FROM phrases JOIN d ON contains(s, ' ' || phrase || ' ')""",
)
def phrase_and_postings(t: Tables) -> DataFrame:
    from ..functions import text as tx

    phrases = t.benchmark.select(F.array_join(F.slice(tx.tokenize(F.col("text")), 1, 5), " ").alias("phrase")).distinct()
    return lexical.phrase_hits(t.documents, phrases)


def lexicon(t: Tables) -> DataFrame:
    """Three conditions with phrases of the benchmark's first words as triggers, positives and penalties."""
    from ..functions import text as tx

    w = tx.tokenize(F.col("text"))
    kind = F.element_at(F.array(F.lit("trigger"), F.lit("positive"), F.lit("penalty")), (F.col("item_id") % 3 + 1).cast("int"))
    rows = t.benchmark.select(F.concat(F.lit("c"), (F.col("item_id") % 4).cast("string")).alias("condition"), kind.alias("kind"), F.array_join(F.slice(w, 1, 2), " ").alias("phrase"))
    return clinical.lexicon(rows)


LEXICON = f"lex AS (SELECT DISTINCT 'c' || (item_id % 4)::VARCHAR AS condition, ['trigger', 'positive', 'penalty'][item_id % 3 + 1] AS kind, array_to_string({TOK.format('text')}[1:2], ' ') AS norm FROM benchmark)"
PADDED = f"d AS (SELECT doc_id, ' ' || array_to_string({TOK.format('text')}, ' ') || ' ' AS s FROM documents)"


@query("detect_conditions", f"WITH {LEXICON}, {PADDED} SELECT DISTINCT doc_id AS qid, condition FROM d JOIN lex ON kind = 'trigger' AND contains(s, ' ' || norm || ' ')")
def detect_conditions(t: Tables) -> DataFrame:
    return clinical.detect(t.documents.select(F.col("doc_id").alias("qid"), "text"), lexicon(t))


@query("condition_index", f"WITH {LEXICON}, {PADDED} SELECT condition, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM d JOIN lex ON kind = 'trigger' AND contains(s, ' ' || norm || ' ') GROUP BY 1")
def condition_index(t: Tables) -> DataFrame:
    return clinical.condition_index(t.documents, lexicon(t)).groupBy("condition").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(
    "ce_bias",
    f"""WITH {LEXICON}, {PADDED}, cand AS (SELECT o.doc_id AS qid, d.doc_id FROM d, (SELECT doc_id FROM documents WHERE doc_id < 8) o WHERE d.doc_id % 8 = o.doc_id),
cond AS (SELECT DISTINCT o.doc_id AS qid, condition FROM d o JOIN lex ON kind = 'trigger' AND contains(s, ' ' || norm || ' ') WHERE o.doc_id < 8),
f AS (SELECT DISTINCT doc_id, condition, kind FROM d JOIN lex ON kind <> 'trigger' AND contains(s, ' ' || norm || ' ')),
h AS (SELECT c.qid, c.doc_id, max(CASE WHEN kind = 'positive' THEN 1 ELSE 0 END) AS pos, max(CASE WHEN kind = 'penalty' THEN 1 ELSE 0 END) AS pen FROM cand c JOIN cond USING (qid) JOIN f USING (doc_id, condition) GROUP BY 1, 2)
SELECT qid, doc_id, round(CAST(coalesce(pos, 0) * 0.15 - coalesce(pen, 0) * 0.20 AS DOUBLE), 6) AS bias FROM cand LEFT JOIN h USING (qid, doc_id)""",
)
def ce_bias(t: Tables) -> DataFrame:
    cand = t.documents.select((F.col("doc_id") % 8).alias("qid"), "doc_id")
    cond = clinical.detect(t.documents.filter("doc_id < 8").select(F.col("doc_id").alias("qid"), "text"), lexicon(t))  # the queries
    return clinical.bias(cand, t.documents, cond, lexicon(t)).select("qid", "doc_id", F.round("bias", 6).alias("bias"))


@query(
    "bias_keys",
    f"""WITH {LEXICON}, lx AS (SELECT CASE WHEN condition = 'c0' AND kind = 'penalty' THEN '*' ELSE condition END AS condition, kind, norm FROM lex), n AS (SELECT doc_id, array_to_string({TOK.format('text')}, ' ') AS s FROM documents),
c AS (SELECT (doc_id % 4) AS qid, doc_id, 'c' || (doc_id % 4) AS condition FROM n),
h AS (SELECT c.qid, c.doc_id, lx.condition, kind, norm FROM c JOIN n USING (doc_id) JOIN lx ON kind <> 'trigger' AND contains(s, norm) AND (lx.condition = c.condition OR lx.condition = '*' AND kind = 'penalty'))
SELECT c.qid, c.doc_id, coalesce(string_agg(DISTINCT norm, '|' ORDER BY norm) FILTER (WHERE h.condition = '*'), '') AS global_penalties, coalesce(string_agg(DISTINCT norm, '|' ORDER BY norm) FILTER (WHERE h.condition <> '*' AND kind = 'positive'), '') AS positives,
  coalesce(string_agg(DISTINCT norm, '|' ORDER BY norm) FILTER (WHERE h.condition <> '*' AND kind = 'penalty'), '') AS penalties FROM c LEFT JOIN h USING (qid, doc_id) GROUP BY 1, 2""",
)
def bias_keys(t: Tables) -> DataFrame:
    general = (F.col("condition") == "c0") & (F.col("kind") == "penalty")
    lex = lexicon(t).withColumn("condition", F.when(general, "*").otherwise(F.col("condition")))
    cand = t.documents.select((F.col("doc_id") % 4).alias("qid"), "doc_id")
    cond = t.documents.select((F.col("doc_id") % 4).alias("qid")).distinct().withColumn("condition", F.concat(F.lit("c"), F.col("qid").cast("string")))
    out = clinical.bias_keys(cand, t.documents, cond, lex)
    return out.select("qid", "doc_id", *[F.array_join(c, "|").alias(c) for c in ("global_penalties", "positives", "penalties")])


def pipeline(t: Tables) -> dict[str, DataFrame]:
    queries = t.benchmark.select(F.col("item_id").alias("qid"), "text")
    return search(t.documents.select("doc_id", "text"), queries, SearchConfig(), lexicon=lexicon(t))


#: The whole pipeline: hits, fused with the union's boost, and reranked by overlap and biases.
PIPELINE = f"""b AS ({bm25_sql(1.5, 120, True, digits=None)}),
f0 AS (SELECT qid, doc_id, 0.55 * CASE WHEN max(score) OVER p - min(score) OVER p > 1e-12 THEN (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) ELSE 0.5 END AS score FROM b WINDOW p AS (PARTITION BY qid)),
{LEXICON}, {PADDED}, q AS (SELECT item_id AS qid, list_distinct({TOK.format('text')}) AS w, ' ' || array_to_string({TOK.format('text')}, ' ') || ' ' AS s FROM benchmark),
cond AS (SELECT DISTINCT qid, condition FROM q JOIN lex ON kind = 'trigger' AND contains(s, ' ' || norm || ' ')),
found AS (SELECT DISTINCT doc_id, condition, kind FROM d JOIN lex ON contains(s, ' ' || norm || ' ')),
u AS (SELECT DISTINCT qid, doc_id FROM cond JOIN found USING (condition) WHERE kind = 'trigger'),
f1 AS (SELECT f0.qid, f0.doc_id, score + CASE WHEN u.qid IS NULL THEN 0 ELSE 0.05 END AS score FROM f0 LEFT JOIN u USING (qid, doc_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM f1) WHERE rank <= 50),
bias AS (SELECT qid, doc_id, 0.15 * max(CASE WHEN kind = 'positive' THEN 1 ELSE 0 END) - 0.20 * max(CASE WHEN kind = 'penalty' THEN 1 ELSE 0 END) AS bias FROM cond JOIN found USING (condition) WHERE kind <> 'trigger' GROUP BY 1, 2),
c AS (SELECT h.qid, h.doc_id, 0.5 * (len(list_filter(q.w, lambda x: contains(d.s, ' ' || x || ' '))) / len(q.w) + coalesce(bias, 0)) + 0.5 * h.score AS score FROM fused h JOIN q USING (qid) JOIN d ON d.doc_id = h.doc_id LEFT JOIN bias ON bias.qid = h.qid AND bias.doc_id = h.doc_id WHERE h.rank <= 25),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM c) WHERE rank <= 20)"""


@query("pipeline_topk", f"WITH {PIPELINE} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM reranked")
def pipeline_topk(t: Tables) -> DataFrame:
    return shown(pipeline(t)["result"])


@query(
    "stage_trace",
    f"WITH {PIPELINE}, s AS (SELECT 'bm25' AS stage, qid, score FROM b UNION ALL SELECT 'fused', qid, score FROM fused UNION ALL SELECT 'reranked', qid, score FROM reranked), g AS (SELECT stage, qid, count(*) AS n, max(score) AS best FROM s GROUP BY 1, 2) SELECT stage, count(*) AS queries, CAST(sum(n) AS BIGINT) AS candidates, round(avg(best), 6) AS avg_best FROM g GROUP BY 1",
)
def stage_trace(t: Tables) -> DataFrame:
    return trace.summary(pipeline(t)["trace"]).select("stage", "queries", "candidates", F.round("avg_best", 6).alias("avg_best"))
