"""Shared Spark helpers: durable cuts of lineage, running totals without a single-task window, connected components."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark is local.

    On a cluster an own folder would be another one on each machine, so there a missing setting is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{os.path.join(tempfile.gettempdir(), 'lexispark-checkpoints')}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


class _Open(threading.local):
    """Paths of the tables written in each open ``scratch`` of a thread, the innermost last."""

    def __init__(self):
        self.paths: list[list[str]] = []


_open = _Open()


def stored(df: DataFrame, partition_by: tuple[str, ...] = (), name: str = "table") -> DataFrame:
    """Writes ``df`` as Parquet (zstd) to the shared folder and reads it back: a cut of lineage that outlives executors.

    The table is deleted when its ``scratch`` is left, if there is one, and else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open.paths:
        _open.paths[-1].append(path)
    at, files = _file(spark, path)
    files.deleteOnExit(at)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables stored within, on leaving, but for those that ``keep`` has been called with.

    What is returned from within must not read the others any more.
    """
    own: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.stored_at)
        return df

    _open.paths.append(own)
    try:
        yield keep
    finally:
        _open.paths.pop()
        discard(spark, [p for p in own if p not in kept])
        if _open.paths:
            _open.paths[-1].extend(kept)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables by path."""
    for path in paths:
        at, files = _file(spark, path)
        files.delete(at, True)


def _bytes(size: str) -> int:
    """A Spark size setting (1g, 512m, plain MiB) in bytes."""
    m = re.fullmatch(r"\s*(\d+)\s*([kmgt]?)b?\s*", size.lower())
    return int(m[1]) << {"k": 10, "m": 20, "": 20, "g": 30, "t": 40}[m[2]] if m else 1 << 30


def room(spark: SparkSession, most: float = 16.0) -> float:
    """GB of executor memory for each core that runs tasks, from 1 to ``most``.

    Blocks and buckets of the block-and-bucket exchanges grow with it. Rows between them are blocks times buckets, each with a
    block's share of a bucket, so on executors of 16 GB a core they are 256 times fewer and larger than on those of 1 GB; what
    a large corpus needs is large executors, not another plan.
    """
    conf = spark.sparkContext.getConf()
    cores = int(conf.get("spark.executor.cores", "1"))
    if spark.sparkContext.master.startswith("local"):
        return min(most, max(1.0, _bytes(conf.get("spark.driver.memory", "1g")) / (1 << 30) / spark.sparkContext.defaultParallelism))
    return min(most, max(1.0, _bytes(conf.get("spark.executor.memory", "1g")) / (1 << 30) / cores))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: bounds the Arrow batches of this session to ``rows``, unless it has set a bound of its own.

    A batch is held by the JVM, on its way and by the worker at once, so it decides what an executor needs beside its heap.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))


def spread(scan: DataFrame) -> DataFrame:
    """Deals a scan with fewer splits than cores (a small file of one row group) out to all of them; others stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores)


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Selects ``columns`` (own name -> new name) only, so that a caller's further columns never clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items()])


def around(df: DataFrame, taken: list[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs an operator that adds columns named as in ``taken``, and gives back the rows it keeps with the columns of ``df``:
    columns of ``df`` that have such names are set aside and restored."""
    aside = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c in taken}
    out = operator(df.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in df.columns]))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in df.columns])


def running_total(df: DataFrame, keys: list[str], group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running total of ``value`` per ``keys`` in the order (group, order).

    Two levels: a window inside each (keys, group), and one over the group sums, so a hot key spreads over its groups.
    ``group`` must be a non-null integer column that the order follows.
    """
    inner = Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys, group).agg(F.sum(value).alias("_sum")).select(*keys, group, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    within = df.withColumn("_within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    # merge: the optimiser takes exploded rows for few, and would broadcast
    return within.join(base.hint("merge"), [*keys, group]).withColumn(out, F.col("_base") + F.col("_within")).drop("_base", "_within")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (node, root), root the smallest node reachable.

    Alternates large-star and small-star passes (minimum by partial aggregation, then a join that AQE can split where one
    node is hot) until no edge changes, which takes a number of passes that grows with the logarithm of the nodes; each pass is
    checkpointed to the shared folder. Nodes without an edge are absent.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct().checkpoint()
    before = None
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        large = large.checkpoint()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))
        now = small.filter("hi <> lo").distinct().checkpoint()
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == before:
            return now.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root").unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        before = state
