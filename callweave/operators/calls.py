"""Steps that look at one call at a time: count, gate, sentences, chunks. None of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.constants import CHUNK_CHARS, CHUNK_OVERLAP, MIN_CALL_TOKENS, MIN_SENTENCE_WORDS
from callweave.functions import text as tx


def with_token_count(calls: DataFrame, text: str = "transcription") -> DataFrame:
    return calls.withColumn("word_count", tx.token_count(F.col(text)).cast("bigint"))


def is_long_enough(token_count: Column) -> Column:
    return token_count > MIN_CALL_TOKENS


def split_sentences(
    calls: DataFrame, key: str | Sequence[str] = "conv_id", text: str = "transcription", min_words: int = MIN_SENTENCE_WORDS
) -> DataFrame:
    """``key, position, sentence``; positions count the kept sentences from 0. ``key`` may name several columns to carry."""
    kept = tx.sentences(F.col(text), min_words)
    keys = [key] if isinstance(key, str) else list(key)
    return calls.select(*keys, F.posexplode(kept).alias("position", "sentence")).withColumn(
        "position", F.col("position").cast("bigint")
    )


def split_chunks(
    calls: DataFrame,
    key: str = "conv_id",
    text: str = "transcription",
    size: int = CHUNK_CHARS,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """``key, chunk_no, chunk``; every call has at least one chunk."""
    return calls.select(
        key, F.posexplode(tx.chunks(F.col(text), size, overlap)).alias("chunk_no", "chunk")
    ).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


def combine_chunks(parts: DataFrame, key: str = "conv_id", text: str = "summary") -> DataFrame:
    """Chunk results of one call joined by line breaks in chunk order."""
    ordered = F.sort_array(F.collect_list(F.struct("chunk_no", F.col(text).alias("part"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n").alias(text))
