"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule looks at one statistic of the whole text and says good, bad or nothing. Nobody says how good the rules are:
expectation-maximisation estimates, from all documents, how often each rule says good of good and bad of bad documents,
and a document is kept by its posterior probability. Texts are reduced to statistics row by row, without a shuffle; what is
shuffled is the table of vote patterns, of at most three to the power of the number of rules rows. DataFrame functions
only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import WORD, save, shield

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50  # of the base rule
MAX_REPEATED = 50  # percent of words, of the base rule
ROUNDS = 100  # a guard: estimates that have not settled by then raise
_INNER = ("_words", "_lines", "_windows", "_placed", "_held", "_places")
SETTLED = 1e-4
START_PRIOR, START_GOOD, START_BAD = 0.8, 0.99, 0.2  # good documents; good ones called good; bad ones called bad
GOOD, BAD, ABSTAIN = 1, -1, 0


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else good where ``good`` holds, else no vote. SQL over the columns of ``text_statistics``."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 60", "n_words >= 100"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("symbol_runs", "10 * n_symbol_runs > n_words", "50 * n_symbol_runs <= n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    Rule("repeats", "100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 10 * n_words"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars", "100 * n_capitals <= 10 * word_chars"),
    Rule("exclamations", "5 * n_exclamations > n_words", "50 * n_exclamations <= n_words"),
)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_exclamations, n_symbol_runs, n_capitals``, all long. A null text has no words and no lines. Columns of these names are replaced,
    all others carried along."""
    docs, back = shield(docs, _INNER)
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(WORD)))
    split = docs.withColumns(
        {
            "_words": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
            "_lines": lines,
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
            "n_symbol_runs": F.regexp_count(text, F.lit(f"{SYMBOLS}+")).cast("bigint"),
            "n_capitals": F.regexp_count(text, F.lit("[A-Z]")).cast("bigint"),
            "n_exclamations": (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("!"), F.lit("")))).cast("bigint"),
        }
    ).drop("text")
    starts = F.sequence(F.lit(1), F.size("_words") - 2)
    window = lambda i: F.xxhash64(
        F.element_at("_words", i), F.element_at("_words", i + 1), F.element_at("_words", i + 2)
    )
    counted = split.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_lines": F.size("_lines").cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_windows": F.when(F.size("_words") >= 3, F.transform(starts, window)),
        }
    ).drop("_words", "_lines")
    return _count_repeats(counted).withColumnsRenamed(back)


def _count_repeats(counted: DataFrame) -> DataFrame:
    """Words covered by windows that occur twice or more. Sorted by hash, equal windows stand side by side; the gaps
    between the places of those windows, three at most each, are the words covered.

    Every step is a column of its own: an expression named twice inside a lambda would run once for each element.
    """
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    place = lambda h, i: F.struct(h.alias("h"), i.alias("i"))
    beside = lambda x, k: (x["h"] == F.get("_placed", k - 1)["h"]) | (x["h"] == F.get("_placed", k + 1)["h"])
    gap = lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_places", k + 1) - p, F.lit(3)))
    placed = counted.withColumn("_placed", F.when(repeats, F.sort_array(F.transform("_windows", place)))).drop("_windows")
    held = placed.withColumn("_held", F.filter("_placed", beside)).drop("_placed")
    places = held.withColumn("_places", F.sort_array(F.transform("_held", lambda x: x["i"]))).drop("_held")
    words = F.aggregate(F.transform("_places", gap), F.lit(0), lambda a, g: a + g)
    return places.withColumn("n_repeat_words", F.coalesce(words, F.lit(0)).cast("bigint")).drop("_places")


def judge_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` without ``text``, with the columns of ``text_statistics``, ``base_failed``, ``votes`` (an array in the order of the
    rules), ``good`` (posterior probability) and ``kept``. One row for each row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of the words repeat. ``kept`` is false for these, and else true where
    ``good`` is at least one half. Null, empty and blank texts fail. Repeated rows each count and are judged alike; ids are
    never read. An empty table gives an empty result. Columns of ``docs`` with these names are replaced.
    """
    counted = save(text_statistics(docs), "statistics")
    vote = lambda r: F.when(F.expr(r.bad), BAD).when(F.expr(r.good), GOOD).otherwise(ABSTAIN)
    voted = counted.withColumn("votes", F.array(*[vote(r) for r in rules]))
    # what the base rule rejects is bad whatever the others say; they learn from the rest
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    voted = voted.withColumn("base_failed", failed)
    patterns = save(voted.where(~failed).groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    good = posterior(estimate(patterns, len(rules)))
    return voted.withColumn("good", good).withColumn("kept", ~F.col("base_failed") & (F.col("good") >= 0.5))


@dataclass(frozen=True)
class Model:
    """``prior`` of a good document; for each rule how often it says good of a good and bad of a bad one, when it votes."""

    prior: float
    good: tuple[float, ...]
    bad: tuple[float, ...]


def posterior(model: Model) -> Column:
    """Probability of a good document given ``votes``. An abstaining rule says nothing either way."""
    log_odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, (g, b) in enumerate(zip(model.good, model.bad, strict=True)):
        says = F.get("votes", F.lit(j))
        log_odds = log_odds + F.when(says == GOOD, math.log(g / (1 - b))).when(says == BAD, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-log_odds))


def estimate(patterns: DataFrame, n_rules: int) -> Model:
    """Expectation-maximisation over vote patterns (``votes, n``). A round is one aggregation to a single row of sums.

    It begins with rules that accuse one good document in a hundred and catch a fifth of the bad ones, as rules do that
    each look for a fault of their own; that start counts as one document, so no rule becomes certain. It ends when
    nothing moves by more than ``SETTLED``. What it can tell are faults that at least two rules see, so each fault has two.
    """
    model = Model(START_PRIOR, (START_GOOD,) * n_rules, (START_BAD,) * n_rules)
    says = [F.get("votes", F.lit(j)) for j in range(n_rules)]
    for _ in range(ROUNDS):
        good = posterior(model)
        total = lambda weight, when=None: F.coalesce(F.sum(F.col("n") * weight if when is None else F.when(when, F.col("n") * weight)), F.lit(0.0))
        sums = [total(good), total(F.lit(1.0))]
        for s in says:
            sums += [total(good, s == GOOD), total(good, s != ABSTAIN), total(1 - good, s == BAD), total(1 - good, s != ABSTAIN)]
        row = patterns.agg(*[x.alias(f"s{k}") for k, x in enumerate(sums)]).first()
        share = lambda a, b, start: round((a + start) / (b + 1), 9)
        new = Model(
            share(row[0], row[1], START_PRIOR),
            tuple(share(row[2 + 4 * j], row[3 + 4 * j], START_GOOD) for j in range(n_rules)),
            tuple(share(row[4 + 4 * j], row[5 + 4 * j], START_BAD) for j in range(n_rules)),
        )
        moved = max(abs(a - b) for a, b in zip((new.prior, *new.good, *new.bad), (model.prior, *model.good, *model.bad), strict=True))
        model = new
        if moved <= SETTLED:
            return model
    raise RuntimeError(f"the rules' accuracies did not settle in {ROUNDS} rounds")
