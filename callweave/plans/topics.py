"""The topic job: summaries in, primary and secondary topic of each call out.

Sentences, matches and lists leave their row and meet it again by ``key``, the column that tells rows apart. ``conv_id`` will do
where it is unique and never null; where it is not, ``session.number_rows`` makes a key, and ``assign_topics`` always does.
"""

from __future__ import annotations

from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.constants import COSINE_THRESHOLD, TOP_TOPICS
from callweave.functions.values import primary_topic, secondary_topic
from callweave.operators.calls import split_sentences
from callweave.operators.ranking import candidate_lists, top_topics
from callweave.operators.scoring import LABELS, VECTOR, encode, labels_of, vectors_of, with_model
from callweave.operators.similarity import dense_matches, lexical_matches
from callweave.scorers import Encoder, PairClassifier, ZeroShotClassifier
from callweave.session import materialise, number_rows
from callweave.sources.catalogue import Catalogue

ROW = "row_no"


def topic_candidates(summaries: DataFrame, catalogue: Catalogue, text: str = "summary", key: str = "conv_id") -> DataFrame:
    """``key, position, sentence, topic_no, topic, cos_sim`` for every sentence and topic above the threshold."""
    matches = lexical_matches(split_sentences(summaries, key, text), catalogue, (key, "position"))
    return catalogue.name(matches, "topic").select(key, "position", "sentence", "topic_no", "topic", "cos_sim")


def encoded_candidates(
    summaries: DataFrame,
    catalogue: Catalogue,
    encoder: Encoder,
    threshold: float = COSINE_THRESHOLD[0] / COSINE_THRESHOLD[1],
    text: str = "summary",
    key: str = "conv_id",
) -> DataFrame:
    """As ``topic_candidates``, with vectors from an encoder. A sentence that the encoder fails on matches nothing."""
    sentences = materialise(split_sentences(summaries, key, text), "sentences")
    found = _encoded_matches(encoded_texts(sentences, encoder), catalogue, encoder, threshold)
    return sentences.join(found, "sentence").select(key, "position", "sentence", "topic_no", "topic", "cos_sim")


def encoded_texts(
    sentences: DataFrame, encoder: Encoder, parallelism: int | None = None, profile: ResourceProfile | None = None
) -> DataFrame:
    """``sentence, vector, error``: each distinct sentence once, however many rows say it, so that it is encoded and matched once.

    Equal sentences are found before the shuffle as far as a task holds them. They are spread over ``parallelism`` tasks if given.
    The result is written, so that no later step encodes anything again.
    """
    distinct = sentences.select("sentence").distinct()
    if parallelism or profile:
        distinct = distinct.repartition(*([parallelism] if parallelism else []), "sentence")
    encoded = with_model(distinct, "encoded", vectors_of(encoder), VECTOR, "sentence", profile=profile)
    return materialise(encoded.select("sentence", "encoded.vector", "encoded.error"), "encoded")


def encoded_sentences(
    summaries: DataFrame,
    encoder: Encoder,
    text: str = "summary",
    parallelism: int | None = None,
    key: str = "conv_id",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``key, position, sentence, vector, error`` of every sentence. A sentence that very many rows say is one row of the encoder's
    and meets them by a join, whose large partitions adaptive execution splits."""
    sentences = materialise(split_sentences(summaries, key, text), "sentences")
    encoded = encoded_texts(sentences, encoder, parallelism, profile)
    return sentences.join(encoded, "sentence").select(key, "position", "sentence", "vector", "error")


def _encoded_matches(sentences: DataFrame, catalogue: Catalogue, encoder: Encoder, threshold: float) -> DataFrame:
    """A topic that cannot be encoded fails the job: it is the job's setting, not a call's text."""
    encoded = encode(encoder, "description")
    failed = F.raise_error(F.concat(F.lit("topic not encoded: "), F.col("encoded.error"))).cast("array<float>")
    topics = catalogue.topics.select("topic_no", encoded.alias("encoded")).select(
        "topic_no", F.when(F.col("encoded.error").isNotNull(), failed).otherwise(F.col("encoded.vector")).alias("vector")
    )
    return catalogue.name(dense_matches(sentences.drop("error"), topics, threshold), "topic")


def ranked_topics(matches: DataFrame, catalogue: Catalogue, k: int = TOP_TOPICS, key: str = "conv_id") -> DataFrame:
    """Top ``k`` of each call with topic names and descriptions. The lookup comes after the cut."""
    best = top_topics(matches.select(key, "position", "topic_no", "cos_sim"), key, k)
    return catalogue.name(best, "topic", "description")


def _meets(other: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``other`` with its key renamed, and the condition that two rows agree in it. Null agrees with null."""
    renamed = other.withColumnRenamed(key, f"other_{key}")
    return renamed, F.col(key).eqNullSafe(F.col(f"other_{key}"))


def rerank(
    summaries: DataFrame,
    ranked: DataFrame,
    classifier: ZeroShotClassifier | PairClassifier,
    key: str = "conv_id",
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Every summary with ``top_topics`` and the classifier's ``labels``, best first; both null without candidates."""
    lists, same = _meets(candidate_lists(ranked, key), key)
    listed = summaries.join(lists, same, "left").drop(f"other_{key}")
    return (
        with_model(listed, "outcome", labels_of(classifier), LABELS, "summary", "candidates", profile=profile)
        .withColumns(
            {"labels": F.col("outcome.labels"), "error": F.coalesce(F.col("error"), F.col("outcome.error"))}
        )
        .drop("outcome", "candidates")
    )


def labelled_summaries(
    summaries: DataFrame,
    catalogue: Catalogue,
    classifier: ZeroShotClassifier | PairClassifier,
    encoder: Encoder | None = None,
    k: int = TOP_TOPICS,
    parallelism: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``row_no, conv_id, summary, error, top_topics, labels``: exactly one row per summary, each with topics of its own text only,
    whatever ids the summaries have. ``assign_topics`` says the rest."""
    summaries = number_rows(summaries.select("conv_id", "summary", "error"), ROW)
    usable = summaries.where(F.col("error").isNull())
    if encoder is None:
        matches = lexical_matches(split_sentences(usable, ROW, "summary"), catalogue, (ROW, "position"))
    else:
        sentences = materialise(split_sentences(usable, ROW, "summary"), "sentences")
        encoded = encoded_texts(sentences, encoder, parallelism, profile)
        p, q = COSINE_THRESHOLD
        matches = sentences.join(_encoded_matches(encoded, catalogue, encoder, p / q), "sentence")
        problem = F.min_by("error", "position").alias("encoder_error")
        problems = sentences.join(encoded.where(F.col("error").isNotNull()), "sentence").groupBy(ROW).agg(problem)
        summaries = summaries.join(problems, ROW, "left").withColumn("error", F.coalesce("error", "encoder_error")).drop("encoder_error")
    return rerank(summaries, ranked_topics(matches, catalogue, k, ROW), classifier, ROW, profile)


def assign_topics(
    summaries: DataFrame,
    catalogue: Catalogue,
    classifier: ZeroShotClassifier | PairClassifier,
    encoder: Encoder | None = None,
    k: int = TOP_TOPICS,
    parallelism: int | None = None,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``conv_id, summary, primary_topic, secondary_topic, error``: exactly one row per summary, also where ids repeat or are null.

    Rows that already carry an error are not matched. Without an encoder, sentences are compared by their words. A call
    with a sentence that the encoder fails on has the first such error. ``parallelism`` sets the number of encoder tasks, ``profile``
    what the stages of the models ask for.
    """
    labelled = labelled_summaries(summaries, catalogue, classifier, encoder, k, parallelism, profile)
    return labelled.select(
        "conv_id",
        "summary",
        primary_topic(F.col("labels")).alias("primary_topic"),
        secondary_topic(F.col("labels")).alias("secondary_topic"),
        "error",
    )


def unidentified_calls(summaries: DataFrame, matches: DataFrame, key: str = "conv_id") -> DataFrame:
    """Summaries of which no sentence matched any topic."""
    matched, same = _meets(matches.select(key).distinct(), key)
    return summaries.join(matched, same, "left_anti")
