"""Keeping all cores busy on inputs of few splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Deals a scan with fewer splits than cores out to all of them; a scan of many splits stays as it is, without a shuffle.

    A small file of one row group would otherwise be one task, however much work follows the scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores)
