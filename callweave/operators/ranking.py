"""Best topics of a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.constants import TOP_TOPICS


def top_topics(matches: DataFrame, key: str = "conv_id", k: int = TOP_TOPICS) -> DataFrame:
    """The ``k`` best matches of each call over all its sentences, with their ``rank``.

    One topic may appear several times, from several sentences. Equal similarities are ordered by position, then by
    topic number. Each task keeps only its own best ``k`` per call before the shuffle.
    """
    best_first = Window.partitionBy(key).orderBy(F.desc("cos_sim"), "position", "topic_no")
    return matches.withColumn("rank", F.row_number().over(best_first).cast("bigint")).where(F.col("rank") <= k)


def candidate_lists(ranked: DataFrame, key: str = "conv_id") -> DataFrame:
    """``key, top_topics, candidates``: names in rank order, and the distinct topics among them, first seen first.

    ``ranked`` comes from ``top_topics``, so a group has at most ``k`` rows.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "topic", "description")))
    return (
        ranked.groupBy(key)
        .agg(ordered.alias("ordered"))
        .select(
            key,
            F.col("ordered.topic").alias("top_topics"),
            F.array_distinct(
                F.transform("ordered", lambda t: F.struct(t["topic"].alias("topic"), t["description"].alias("description")))
            ).alias("candidates"),
        )
    )
