"""Text expressions. All are built-in column functions, so they stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.constants import (
    BLANK,
    CHUNK_CHARS,
    CHUNK_OVERLAP,
    EDGE_BLANK_PATTERN,
    MIN_SENTENCE_WORDS,
    SUMMARY_WORD_LIMIT,
    TERM_PATTERN,
    TOKEN_PATTERN,
    WORD_CHAR,
    WORD_PATTERN,
)


def token_count(text: Column) -> Column:
    """Words and single punctuation marks in ``text``."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def has_tokens(text: Column, at_least: int) -> Column:
    """``token_count(text) >= at_least``, reading no further than needed."""
    return text.rlike(rf"^(?:[{BLANK}]*+(?:[{WORD_CHAR}]++|[^{BLANK}{WORD_CHAR}])){{{at_least}}}")


def token_straddles(text: Column, position: Column | int) -> Column:
    """Whether one token covers the characters ``position`` and ``position + 1`` (from 1)."""
    return F.substring(text, position, 2).rlike(rf"^[{WORD_CHAR}]{{2}}$")


def word_count(text: Column) -> Column:
    """Words separated by white space."""
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def has_words(text: Column, at_least: int) -> Column:
    """``word_count(text) >= at_least`` without building the list of words.

    The possessive quantifiers never give characters back, so one pass over the text decides.
    """
    if at_least < 1:
        return text.isNotNull()
    return text.rlike(rf"^[{BLANK}]*+(?:[^{BLANK}]++[{BLANK}]++){{{at_least - 1}}}[^{BLANK}]")


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_BLANK_PATTERN, "")


def terms(text: Column) -> Column:
    """Lower-cased words in text order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def term_counts(term_list: Column) -> Column:
    """``array<struct<term, tf>>`` of a term list. Equal terms are neighbours once sorted, so each count is the distance
    between the starts of two runs: one pass inside the row, no shuffle."""

    def count_runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(ordered, lambda term, i: F.when((i == 0) | (F.get(ordered, i - 1) != term), i)),
            lambda start: start.isNotNull(),
        )
        return _bind(
            starts,
            lambda begun: F.transform(
                begun,
                lambda start, k: F.struct(
                    F.get(ordered, start).alias("term"),
                    (F.coalesce(F.get(begun, k + 1), F.size(ordered)) - start).cast("bigint").alias("tf"),
                ),
            ),
        )

    return _bind(F.sort_array(term_list), count_runs)


def squared_norm(counts: Column) -> Column:
    """Sum of squared term counts."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, c: acc + c["tf"] * c["tf"])


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def pieces(text: Column) -> Column:
    """Parts between full stops, untrimmed, the stops removed."""
    return F.split(text, r"\.", -1)


def sentences(text: Column, min_words: int = MIN_SENTENCE_WORDS) -> Column:
    """Parts between full stops that have at least ``min_words`` words; the index in this array is the position."""
    return F.filter(pieces(text), lambda piece: has_words(piece, min_words))


def chunks(text: Column, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Pieces of ``size`` characters, each starting ``overlap`` characters before the end of the one before it.

    The text is cut once into strides of ``size - overlap`` characters and each stride is lengthened by the head of
    the next one. That reads the text once; taking each chunk by its offset would count from the start every time.
    """
    stride = size - overlap
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))

    def lengthen(strides: Column) -> Column:
        n = F.size(strides)
        # A last stride no longer than the overlap is already inside the chunk before it.
        covered = (n > 1) & (F.length(F.try_element_at(strides, F.lit(-1))) <= overlap)
        count = F.when(covered, n - 1).otherwise(n)
        return F.transform(
            F.slice(strides, F.lit(1), count),
            lambda part, i: F.concat(
                part, F.substring(F.coalesce(F.try_element_at(strides, (i + 2).cast("int")), F.lit("")), 1, overlap)
            ),
        )

    return F.when(text == "", F.array(F.lit(""))).otherwise(_bind(cut, lengthen))


def extract(text: Column, word_limit: int = SUMMARY_WORD_LIMIT) -> Column:
    """The sentences of a text with most distinct terms, in text order, under ``word_limit`` words, each closed by a full stop.

    Every sentence is read. One of ``word_limit`` words or more is cut into runs below that first, so that the best run always
    fits and no text with a word gives an empty answer. Of equal ones the earlier is better; they are taken best first
    until the limit is reached.
    """
    run = rf"[{BLANK}]*+(?:[^{BLANK}]++[{BLANK}]*+){{1,{word_limit - 1}}}"
    # so many words take at least as many blanks between them: most sentences are too short to be cut
    in_runs = lambda piece: F.when(F.length(piece) < 2 * word_limit - 1, F.array(piece)).otherwise(
        F.regexp_extract_all(piece, F.lit(run), F.lit(0))
    )
    runs = F.flatten(F.transform(sentences(text, 1), in_runs))
    weighed = F.transform(
        runs, lambda one, place: F.struct((-F.size(F.array_distinct(terms(one)))).alias("weight"), place.alias("place"), one.alias("run"))
    )
    # each run has a word, so no more than this many can be kept, and only what is taken up to the limit is counted
    best = F.slice(F.sort_array(weighed), 1, word_limit)
    start = F.struct(F.lit(0).alias("words"), F.array().cast("array<struct<place:int,run:string>>").alias("kept"))

    def step(acc: Column, one: Column) -> Column:
        taken = lambda total: F.struct(
            total.alias("words"),
            F.when(total < word_limit, F.concat(acc["kept"], F.array(F.struct(one["place"].alias("place"), one["run"].alias("run")))))
            .otherwise(acc["kept"])
            .alias("kept"),
        )
        return F.when(acc["words"] < word_limit, _bind(acc["words"] + word_count(one["run"]), taken)).otherwise(acc)

    kept = F.aggregate(best, start, step, lambda acc: F.sort_array(acc["kept"]))
    return trim_blank(F.array_join(F.transform(kept, lambda one: F.concat(one["run"], F.lit("."))), ""))
