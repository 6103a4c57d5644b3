"""Input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fill_cluster(df: DataFrame, key: str) -> DataFrame:
    """Spread a source by key when it has fewer partitions than the cluster has cores.

    A few large files, or files with a single row group, would leave the cluster idle while a handful of tasks do the
    text work. A source of many files is left as it is and is not shuffled.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
