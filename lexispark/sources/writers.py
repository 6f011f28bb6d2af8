"""Sinks: predictions, metrics, traces, subsets, reports; and appends that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_remaining(df: DataFrame, path: str, key: str, kind: str = "parquet") -> int:
    """Appends the rows whose key the sink (``parquet`` or ``json`` lines) does not hold yet; the number appended.

    Only the sink's key column is read. Safe to run again after a failure: a failed job commits no files.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key) if kind == "parquet" else spark.read.schema(df.select(key).schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = df.select(key).limit(0)
    left = df.join(done.distinct(), key, "left_anti").persist()
    try:
        n = left.count()
        if n:
            w = left.write.mode("append")
            w.option("compression", "zstd").parquet(path) if kind == "parquet" else w.json(path)
    finally:
        left.unpersist()
    return n


def part(df: DataFrame, path: str, number: int, column: str = "part") -> None:
    """Writes one numbered part of a sink; writing it again replaces it, so a run that resumes repeats no rows and reads none."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{column}={number}")


def merged(spark: SparkSession, parts: str, path: str, files: int, column: str = "part") -> None:
    """All parts of a sink as one table of ``files`` files."""
    spark.read.parquet(parts).drop(column).repartition(files).write.mode("overwrite").option("compression", "zstd").parquet(path)


def trace(df: DataFrame, path: str, run_id: str) -> None:
    """Stage traces of a run, partitioned by run and stage."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id", "stage").parquet(path)


def subset_rows(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Each row once for every subset it belongs to, ``all`` among them."""
    names = F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in flags.items()]))
    return df.withColumn("subset", F.explode(names))


def subset_counts(rows: DataFrame) -> DataFrame:
    """(subset, n) of the rows of ``subset_rows``."""
    return rows.groupBy("subset").agg(F.count("*").alias("n"))


def subsets(df: DataFrame, flags: dict[str, Column], path: str) -> DataFrame:
    """Writes each row to the partition of every subset it belongs to (empty ones have none); returns (subset, n)."""
    subset_rows(df, flags).write.mode("overwrite").partitionBy("subset").parquet(path)
    return subset_counts(df.sparkSession.read.parquet(path))


def long_form(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, metric, value, type): every other column as text rows."""
    kinds = {c: t for c, t in df.dtypes if c not in keys}
    rows = df.select(*keys, *[F.col(c).cast("string").alias(c) for c in kinds]).unpivot(keys, list(kinds), "metric", "value")
    kind = None
    for c, t in kinds.items():
        kind = F.when(F.col("metric") == c, t) if kind is None else kind.when(F.col("metric") == c, t)
    return rows.withColumn("type", kind)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small aggregate as a Markdown table (at most ``most`` rows)."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows]) + "\n"
