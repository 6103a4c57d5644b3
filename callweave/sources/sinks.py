"""Runs: results kept by run date, replaced as a whole.

A run's rows are written to a folder of their own, ``data/run_date=.../version=...``, and count only once an entry of the ``log``
names that version. An entry is one row in one file, which a rename brings into the folder, so a reader finds the old run
or the new one and never a part of either. A write that fails leaves files that no entry names. An entry replaces its
run, or adds to it: a stream adds the result of each batch under a version named after the batch.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "run_date string, seq bigint, version string, adds boolean"


def write_run(df: DataFrame, path: str, run_date: str) -> None:
    """Replace the run of ``run_date``, also by a run without rows, and leave all others alone. A repeated run is harmless, and one that
    fails leaves the run as it was."""
    version = uuid.uuid4().hex
    _write_version(df, path, run_date, version)
    _append(df.sparkSession, path, run_date, version, adds=False)


def add_to_run(df: DataFrame, path: str, run_date: str, version: str) -> bool:
    """Add rows to the run of ``run_date`` under a ``version`` that names their origin, unless that version was added before to any run.
    What an attempt that did not end left of it is overwritten. Returns whether it was added."""
    spark = df.sparkSession
    if _entries(spark, path).where(F.col("version") == version).take(1):
        return False
    _write_version(df, path, run_date, version)
    _append(spark, path, run_date, version, adds=True)
    return True


def run_versions(spark: SparkSession, path: str) -> DataFrame:
    """``run_date, version`` of all that counts: the last entry of each run that replaced it, and those added since."""
    since = Window.partitionBy("run_date").orderBy("seq", "version").rowsBetween(0, Window.unboundedFollowing)
    later = F.count_if(~F.col("adds")).over(since) - F.when(F.col("adds"), 0).otherwise(1)
    return _entries(spark, path).withColumn("later", later).where("later = 0").select("run_date", "version").distinct()


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str, run_date: str | None = None) -> DataFrame:
    """The rows of one run, or of all with their ``run_date``. A run that was never written raises.

    The log has a row for each run and batch, and only its names of versions reach the driver, as names of files do.
    """
    versions = run_versions(spark, path)
    if run_date is not None:
        versions = versions.where(F.col("run_date") == run_date)
    named = sorted(tuple(row) for row in versions.collect())
    if not named:
        raise ValueError(f"no run {run_date or ''} in {path}")
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    partitions = T.StructType([T.StructField("run_date", T.StringType()), T.StructField("version", T.StringType())])
    columns = T.StructType([field for field in wanted if field.name not in partitions.names])
    folders = [f"{_base(path)}/run_date={date}/version={version}" for date, version in named]
    rows = spark.read.schema(T.StructType([*columns, *partitions])).option("basePath", _base(path)).parquet(*folders)
    return rows.select(*columns.names) if run_date is not None else rows.drop("version")


def _base(path: str) -> str:
    return f"{path.rstrip('/')}/data"


def _write_version(df: DataFrame, path: str, run_date: str, version: str) -> None:
    df.drop("run_date", "version").write.mode("overwrite").parquet(f"{_base(path)}/run_date={run_date}/version={version}")


def _entries(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG).parquet(f"{path.rstrip('/')}/log")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def _append(spark: SparkSession, path: str, run_date: str, version: str, adds: bool) -> None:
    last = _entries(spark, path).agg(F.max("seq")).first()[0]
    entry = spark.createDataFrame([(run_date, 0 if last is None else last + 1, version, adds)], LOG)
    entry.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/log")
