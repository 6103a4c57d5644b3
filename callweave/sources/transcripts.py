"""Readers for calls. A missing or unreadable path raises; nothing is swallowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from callweave.sources.sinks import read_runs

UTTERANCE = T.StructType(
    [
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
CALLS_SCHEMA = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("anonymized", T.ArrayType(UTTERANCE))]
)
TURNS_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), *UTTERANCE.fields])
SUMMARIES_SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("transcription", T.StringType()),
        T.StructField("word_count", T.LongType()),
        T.StructField("actions_taken", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_calls(spark: SparkSession, path: str, schema: T.StructType = CALLS_SCHEMA) -> DataFrame:
    """One row per call, the utterances in the array ``anonymized``."""
    return spark.read.schema(schema).parquet(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """One row per utterance."""
    return spark.read.schema(TURNS_SCHEMA).parquet(path)


def read_summaries(spark: SparkSession, path: str, run_date: str | None = None) -> DataFrame:
    """What the summarise job wrote, cut to what the topic job reads: the run of ``run_date``, or a plain folder of summaries."""
    if run_date is not None:
        return read_runs(spark, path, SUMMARIES_SCHEMA, run_date).select("conv_id", "summary", "error")
    return spark.read.schema(SUMMARIES_SCHEMA).parquet(path).select("conv_id", "summary", "error")
