"""The corpus pipeline: STAGES applied in order to ``documents``, each stage's result the next one's input.

All but the last stage return the columns of ``documents``; the last gives, per document left, how many words the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import cdc, mixing, neardup, quality, winnow
from lexispark.llm.common import discard, scratch, spread, stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the positive-unlabelled classifier rejects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.held_out())
    return quality.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash candidates of five-word shingle similarity 0.8 or more link, the one with the
    smallest id."""
    return neardup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages out of all but the first document that has them; every row stays."""
    out = cdc.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a benchmark window occurs."""
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: The stages' models, hashes and pseudorandom draws have no counterpart in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the directory's documents; each stage's result is written to the shared folder and read back, and what no
    later stage reads is deleted."""
    docs, before = spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), []
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name=name))
        discard(spark, before)
        before = [docs.stored_at]
    return STAGES[-1][1](spark, docs, sf_dir)
