"""The summarise job: calls in, one row per call out with summary and agent actions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.constants import MIN_CALL_TOKENS, NO_ACTIONS, NO_SUMMARY
from callweave.functions import text as tx
from callweave.functions.prompts import actions_prompt, summary_prompt
from callweave.functions.values import error_text
from callweave.operators.calls import is_long_enough, with_token_count
from callweave.operators.scoring import TEXT, generate, texts_of, with_answers, with_model
from callweave.scorers import TextModel
from callweave.session import materialise

RESULT_COLUMNS = ("conv_id", "transcription", "word_count", "actions_taken", "summary", "error")


def gate(calls: DataFrame) -> DataFrame:
    """Adds ``is_scored``, and the texts that stand in for model output on the calls that are not."""
    failed = F.col("error").isNotNull()
    return (
        calls.withColumn("is_scored", ~failed & is_long_enough(F.col("word_count")))
        .withColumn("actions_taken", F.when(failed, error_text(F.col("error"))).when(~F.col("is_scored"), F.lit(NO_ACTIONS)))
        .withColumn("summary", F.when(failed, error_text(F.col("error"))).when(~F.col("is_scored"), F.lit(NO_SUMMARY)))
    )


def summarise_calls(
    calls: DataFrame,
    summary_model: TextModel,
    actions_model: TextModel,
    parallelism: int | None = None,
    chunker: Callable[[Column], Column] = tx.chunks,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run both models over ``conv_id, transcription, error`` and, where there is one, ``agent_text``, the text that the actions
    are asked of (else the whole call). One row out for each row in, whatever ids they have.

    The unit of work is one prompt: part 0 of a call asks for the actions, parts 1.. are its chunks, for the summary.
    Parts are spread over the cluster, so that a call of many chunks does not keep one model busy alone. The calls are
    numbered and written once; only answers and counts come back, and meet their call by its number. Calls that are not
    scored have no part. ``parallelism`` sets the number of tasks, e.g. the number of GPUs; ``chunker`` is ``text.chunks`` or
    ``splitting.boundary_chunks``; ``profile`` is what the stages of the models ask for, and no other stage does.
    """
    numbered = materialise(_with_agent_text(calls).withColumn("row_no", F.monotonically_increasing_id()), "calls")
    text = F.col("transcription")
    is_scored = F.col("error").isNull() & tx.has_tokens(text, MIN_CALL_TOKENS + 1)
    parts = F.when(is_scored, F.concat(F.array("agent_text"), chunker(text)))
    exploded = numbered.select("row_no", parts.alias("parts")).select("row_no", F.posexplode("parts").alias("part_no", "text"))
    keys = ("row_no", "part_no")
    spread = exploded.repartition(parallelism, *keys) if parallelism else exploded.repartition(*keys)

    part = F.col("text")
    for_actions = F.when(F.col("part_no") == 0, actions_prompt(part))
    for_summary = F.when(F.col("part_no") > 0, summary_prompt(part))
    if summary_model == actions_model:
        both = with_model(spread, "answer", texts_of(summary_model), TEXT, F.coalesce(for_actions, for_summary), profile=profile)
        answered = both.select(*keys, "answer")
    else:
        asked = with_model(spread, "a", texts_of(actions_model), TEXT, for_actions, profile=profile)
        both = with_model(asked, "s", texts_of(summary_model), TEXT, for_summary, profile=profile)
        answered = both.select(*keys, F.when(F.col("part_no") == 0, F.col("a")).otherwise(F.col("s")).alias("answer"))
    return _by_call(numbered, answered)


def _with_agent_text(calls: DataFrame) -> DataFrame:
    agent = F.col("agent_text") if "agent_text" in calls.columns else F.col("transcription")
    return calls.select("conv_id", "transcription", "error", agent.alias("agent_text"))


def _by_call(numbered: DataFrame, answered: DataFrame) -> DataFrame:
    """One row per call; chunk summaries joined by line breaks in chunk order. The first failed part decides."""
    answer, problem = F.col("answer.text"), F.col("answer.error")
    is_call = F.col("part_no") == 0
    chunk_texts = F.sort_array(F.collect_list(F.when(~is_call, F.struct("part_no", answer.alias("text")))))
    merged = answered.groupBy("row_no").agg(
        F.max(F.when(is_call, answer)).alias("actions"),
        F.array_join(chunk_texts["text"], "\n").alias("chunk_summaries"),
        F.min_by(problem, F.when(problem.isNotNull(), F.col("part_no"))).alias("model_error"),
    )
    joined = numbered.join(merged, "row_no", "left").withColumn("error", F.coalesce("error", "model_error"))
    return _result(with_token_count(joined))


def _result(answered: DataFrame) -> DataFrame:
    """Model answers where the call was scored, the fixed texts elsewhere."""
    return gate(answered).select(
        "conv_id",
        "transcription",
        "word_count",
        _unless_gated("actions_taken", F.col("actions")),
        _unless_gated("summary", F.col("chunk_summaries")),
        "error",
    )


def summarise_in_place(
    calls: DataFrame,
    summary_model: TextModel,
    actions_model: TextModel,
    chunker: Callable[[Column], Column] = tx.chunks,
) -> DataFrame:
    """The result of ``summarise_calls`` row by row, without a shuffle: all prompts of a call go to the model from the
    task that holds the call. For streams, and for calls of ordinary length."""
    text = F.col("transcription")
    gated = gate(with_token_count(_with_agent_text(calls))).drop("actions_taken", "summary")
    summary_prompts = F.when(F.col("is_scored"), F.transform(chunker(text), summary_prompt))
    asked = gated.select(
        "conv_id",
        "transcription",
        "word_count",
        "error",
        generate(actions_model, F.when(F.col("is_scored"), actions_prompt(F.col("agent_text")))).alias("for_actions"),
        summary_prompts.alias("prompts"),
    ).select("*", "for_actions.text", F.col("for_actions.error").alias("actions_error"))
    answered = with_answers(asked.drop("for_actions"), summary_model, "prompts", "texts", "summary_error")
    return _result(
        answered.select(
            "conv_id",
            "transcription",
            "word_count",
            F.coalesce("error", "actions_error", "summary_error").alias("error"),
            F.col("text").alias("actions"),
            F.array_join("texts", "\n").alias("chunk_summaries"),
        )
    )


def extractive_summaries(calls: DataFrame) -> DataFrame:
    """The same result with the built-in extracts as column expressions: no Python, no shuffle."""
    text = F.col("transcription")
    summary = F.array_join(F.transform(tx.chunks(text), lambda chunk: tx.extract(chunk)), "\n")
    gated = gate(with_token_count(_with_agent_text(calls)))
    return gated.select(
        "conv_id",
        "transcription",
        "word_count",
        _unless_gated("actions_taken", tx.extract(F.col("agent_text"))),
        _unless_gated("summary", summary),
        "error",
    )


def _unless_gated(name: str, value: Column) -> Column:
    return F.when(F.col("is_scored"), value).otherwise(F.col(name)).alias(name)
