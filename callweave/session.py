"""Session and scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "callweave", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the submitted configuration is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # text expressions and models cost far more per byte than the default minimum of 1 MB assumes
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: there every task sees the same disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="callweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to a new shared folder and read back, so that no later step computes ``df`` again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, name: str = "row_no") -> DataFrame:
    """``df`` with a number of its own for each row, written once so that every reader sees the same numbers. Ids may repeat or be
    null; a step that goes apart and meets again does so by this number."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver was started."""
    marker = "callweave.shipped"
    if spark.conf.get(marker, None) != spark.sparkContext.applicationId:
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="callweave-pkg-")) / "callweave"
        spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        spark.conf.set(marker, spark.sparkContext.applicationId)
