"""The jobs as they run: read, transform, write a run date, report counts."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from callweave.constants import NO_SUMMARY, UNIDENTIFIED
from callweave.operators.merge import merge_utterances
from callweave.plans.summarise import extractive_summaries, summarise_calls
from callweave.plans.topics import assign_topics
from callweave.scorers import Encoder, PairClassifier, TextModel, ZeroShotClassifier
from callweave.sources.catalogue import Catalogue
from callweave.sources.sinks import write_run
from callweave.sources.transcripts import read_calls, read_summaries


@dataclass
class RunReport:
    """Counts taken while the result was written, at no extra pass."""

    rows: int
    failed: int
    left_out: int  # short calls in the summarise job, calls without topic in the topic job
    seconds: float = field(default=0.0, compare=False)


def run_summarise_job(
    spark: SparkSession,
    calls_path: str,
    out_path: str,
    run_date: str,
    summary_model: TextModel | None = None,
    actions_model: TextModel | None = None,
    parallelism: int | None = None,
    profile: ResourceProfile | None = None,
) -> RunReport:
    """Summaries and actions of the calls in ``calls_path``. Without models, the built-in lead texts."""
    calls = merge_utterances(read_calls(spark, calls_path)).select("conv_id", "transcription", "agent_text", "error")
    if summary_model is None:
        result = extractive_summaries(calls)
    else:
        result = summarise_calls(calls, summary_model, actions_model or summary_model, parallelism, profile=profile)
    return _write(result, out_path, run_date, F.col("summary") == NO_SUMMARY)


def run_topic_job(
    spark: SparkSession,
    summaries_path: str,
    catalogue: Catalogue,
    out_path: str,
    run_date: str,
    classifier: ZeroShotClassifier | PairClassifier,
    encoder: Encoder | None = None,
    parallelism: int | None = None,
    profile: ResourceProfile | None = None,
) -> RunReport:
    """Topics of the summaries of one ``run_date`` in ``summaries_path``."""
    summaries = read_summaries(spark, summaries_path, run_date)
    result = assign_topics(summaries, catalogue, classifier, encoder, parallelism=parallelism, profile=profile)
    return _write(result, out_path, run_date, F.col("primary_topic") == UNIDENTIFIED)


def _write(result: DataFrame, path: str, run_date: str, left_out: Column) -> RunReport:
    counts = Observation()
    observed = result.observe(
        counts,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.count_if(left_out).alias("left_out"),
    )
    start = time.perf_counter()
    write_run(observed, path, run_date)
    return RunReport(**counts.get, seconds=time.perf_counter() - start)
