"""Stage traces: what each stage did to each query's candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage(df: DataFrame, name: str, params: dict[str, str] | None = None) -> DataFrame:
    """(qid, stage, doc_id, score, rank, params) of one stage's ranked rows."""
    p = F.create_map(*[F.lit(x) for kv in (params or {}).items() for x in kv]) if params else F.create_map().cast("map<string,string>")
    return df.select("qid", F.lit(name).alias("stage"), "doc_id", F.col("score").cast("double").alias("score"), F.col("rank").cast("int").alias("rank"), p.alias("params"))


def combined(stages: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, stages)


def flat(trace: DataFrame, stages: list[str]) -> DataFrame:
    """(qid, doc_id, <stage>…): each document's score in each stage."""
    return trace.groupBy("qid", "doc_id").agg(*[F.max(F.when(F.col("stage") == s, F.col("score"))).alias(s) for s in stages])


def summary(trace: DataFrame) -> DataFrame:
    """(stage, queries, candidates, average best score)."""
    q = trace.groupBy("stage", "qid").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    return q.groupBy("stage").agg(F.count("*").alias("queries"), F.sum("n").alias("candidates"), F.avg("best").alias("avg_best"))


def latency(events: DataFrame, stage: str, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(stage, n, avg_value, mean_running): each stage's mean, and the mean of the running averages within ``by``."""
    w = Window.partitionBy(stage, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_a", F.avg(value).over(w))
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"), F.avg("_a").alias("mean_running"))


def run_metadata(results: DataFrame, run_id: str, params: dict[str, str]) -> DataFrame:
    """One row about a run: its id, time, settings, queries and rows."""
    p = F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv]) if params else F.create_map().cast("map<string,string>")
    return results.agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("rows")).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("at"), p.alias("params"), "queries", "rows")
