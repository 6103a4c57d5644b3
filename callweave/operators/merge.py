"""Utterances to one transcript per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.constants import AGENT_ROLE, NULL_LIST_ERROR, NULL_TEXT_ERROR, SEGMENT_TURNS


def _null_text_error(has_null: Column) -> Column:
    return F.when(has_null, F.lit(NULL_TEXT_ERROR))


def merge_utterances(calls: DataFrame, utterances: str = "anonymized") -> DataFrame:
    """Add ``transcription`` and ``error`` to calls that hold their utterances as an array.

    Texts are joined in array order with nothing between them. A null text or a null array does not stop the job: what is
    there is joined, and ``error`` says so. ``agent_text`` holds what the agent said, or the whole call if no utterance
    is marked as the agent's.
    """
    said = F.col(utterances)
    texts = said["text"]
    by_agent = F.filter(said, lambda one: one["role"] == AGENT_ROLE)["text"]
    error = F.when(said.isNull(), F.lit(NULL_LIST_ERROR)).otherwise(_null_text_error(F.exists(texts, lambda text: text.isNull())))
    return calls.withColumn("transcription", F.array_join(texts, "")).withColumns(
        {
            "error": error,
            "agent_text": F.when(F.size(by_agent) > 0, F.array_join(by_agent, "")).otherwise(F.col("transcription")),
        }
    )


def utterance_arrays(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One row per call, ``conv_id, anonymized``: its turns in order. Turns are sorted segment by segment, and a call's row is
    put together from sorted segments."""
    segments = turns.groupBy("conv_id", _segment(segment_turns).alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("part")
    )
    ordered = F.sort_array(F.collect_list(F.struct("segment", "part")))
    return segments.groupBy("conv_id").agg(F.flatten(ordered["part"]).alias("anonymized"))


def merge_turns(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """``conv_id, transcription, agent_text, error`` from one row per utterance; ``agent_text`` as in ``merge_utterances``.

    Calls shorter than a segment need one shuffle on ``conv_id``. Later turns of long calls are concatenated segment by
    segment in groups of their own, and only those strings meet in the call's row, so no task sorts a whole long call.
    Without such turns (file statistics tell) the second branch reads nothing and adaptive execution drops the join.
    """
    in_first = F.col("turn").isNull() | (F.col("turn") < segment_turns)
    first = turns.where(in_first).groupBy("conv_id").agg(*_concat_turns())
    later = (
        turns.where(F.col("turn") >= segment_turns)
        .groupBy("conv_id", _segment(segment_turns).alias("segment"))
        .agg(*_concat_turns())
        .groupBy("conv_id")
        .agg(
            _concat_ordered("segment", F.col("part")).alias("part"),
            _concat_ordered("segment", F.col("agent_part")).alias("agent_part"),
            F.bool_or("has_agent").alias("has_agent"),
            F.bool_or("has_null").alias("has_null"),
        )
    )
    both = first.alias("first").join(later.alias("later"), F.col("first.conv_id").eqNullSafe(F.col("later.conv_id")), "full_outer")
    both_sides = lambda name: F.concat(F.coalesce(f"first.{name}", F.lit("")), F.coalesce(f"later.{name}", F.lit("")))
    either = lambda name: F.coalesce(f"first.{name}", F.lit(False)) | F.coalesce(f"later.{name}", F.lit(False))
    return both.select(
        F.coalesce("first.conv_id", "later.conv_id").alias("conv_id"),
        both_sides("part").alias("transcription"),
        F.when(either("has_agent"), both_sides("agent_part")).otherwise(both_sides("part")).alias("agent_text"),
        _null_text_error(either("has_null")).alias("error"),
    )


def _segment(segment_turns: int) -> Column:
    return F.floor(F.col("turn") / segment_turns).cast("bigint")


def _concat_ordered(order: str, text: Column) -> Column:
    ordered = F.sort_array(F.collect_list(F.struct(order, text.alias("text"))))
    return F.array_join(ordered["text"], "")


def _concat_turns() -> list[Column]:
    by_agent = F.coalesce(F.col("role") == AGENT_ROLE, F.lit(False))
    return [
        _concat_ordered("turn", F.coalesce("text", F.lit(""))).alias("part"),
        _concat_ordered("turn", F.when(by_agent, F.coalesce("text", F.lit(""))).otherwise("")).alias("agent_part"),
        F.bool_or(by_agent).alias("has_agent"),
        F.bool_or(F.col("text").isNull()).alias("has_null"),
    ]
