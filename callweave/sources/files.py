"""Plain files: inventory of a folder tree and their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Every file below ``path`` with size and time. ``content`` is not selected, so no file is opened."""
    return _binary(spark, path, pattern).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime"
    )


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files below ``path`` with their bytes, one row per file."""
    return _binary(spark, path, pattern).select("path", "length", "content")


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
