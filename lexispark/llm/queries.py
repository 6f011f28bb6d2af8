"""Driver queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import mih

    codes = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), mih.sign_code("embedding", 64).alias("code"))
    return mih.top_k(codes, codes.filter("id % 100 = 0")).withColumnRenamed("id", "vec_id")


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import katz

    return katz.fit_and_score(_table(spark, sf_dir, "documents"), ~katz.held_out())[0]


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), quality.held_out())
    return quality.annotate(docs, model).withColumn("held_out", quality.held_out("doc_id")).select("doc_id", "held_out", "score", "predicted")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    return chat.repair(_table(spark, sf_dir, "conversations"))


def op5_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cdc

    return cdc.dedup_substrings(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), toxicity.held_out())
    return toxicity.annotate(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).select("doc_id", "held_out", "score", "predicted")


def op8_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_template

    return html_template.extract(_table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import winnow

    return winnow.annotate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mih": op1_mih,
    "op2_katz": op2_katz,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_cdc": op5_cdc,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_template": op8_template,
    "op9_simhash": op9_simhash,
    "op10_winnow": op10_winnow,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_mih": """
WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN (q.embedding[i] > 0) <> (v.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM ranked WHERE rank <= 10""",
    "op10_winnow": rf"""
WITH dw AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ik AS (SELECT item, w, least(len(w), 10) AS k FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
ks AS (SELECT DISTINCT k FROM ik),
pos AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT p.rid, p.k, p.i, win.item FROM pos p JOIN win ON p.k = win.k AND p.g = win.g),
cover AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT rid, k, i FROM hit)) GROUP BY rid),
who AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (rid) LEFT JOIN who USING (rid)""",
}
