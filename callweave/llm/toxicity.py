"""Toxicity by a lexicon that also catches misspelled terms.

Terms and word stems that set toxic training texts apart are gathered in a trie. The Levenshtein automata of all terms are
intersected with it: a state is a set of trie nodes, each with the edits spent on the way there, and reading a word's letters
leads from state to state. States are built when first reached and kept, so that a word costs one step a letter, and most
words die after a few. Matches are weighed by their surroundings: between quotation marks or after a word of reporting
they count as quotation, else as abuse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import save
from callweave.session import ship_package

MAX_ROWS = 40_000  # labelled training rows, about, that the lexicon and the weights are fitted on: both classes at one rate, by hash
MIN_EVIDENCE = 7.5  # log likelihood ratio of a term; more in a larger sample, where chance finds more
MIN_SHARE = 0.9  # of the texts with a term are toxic
STEMS = (4, 5, 6, 7, 8)  # letters of a stem
ONE_TERM = 0.6  # a stem of which one term makes up this share is no stem of several
WINDOW = 8  # words before a match that may report it
KEPT_STATES = 100_000  # states that a task keeps; beyond that it forgets them and builds them anew
KEPT_WORDS = 500_000
WORD = re.compile(r"[^\W\d_]+")
#: A word, with the digits and signs inside it, or a quotation mark.
TOKEN = re.compile(r"[^\W\d_]+(?:(?:[^\w\s\"“”„«»‹›]|[\d_]){1,2}[^\W\d_]+)*|[\"“”„«»‹›]")
SIGNS = re.compile(r"([\W\d_]+)")
MOST_EDITS = 2
QUOTES = frozenset("\"“”„«»‹›")
#: Words of reporting in the languages of the corpus.
REPORTING = frozenset(
    "said says wrote writes called calls quoted quote quotes term word slur insult sagte schrieb nannte zitierte wort dijo escribió llamó "
    "palabra término dit écrit appelé cité mot terme".split()
)
FEATURES = ("any", "whole", "one_edit", "two_edits", "stem", "quoted", "density")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 9 else MOST_EDITS


@dataclass
class Matcher:
    """The trie of ``terms`` and ``stems`` and the states reached so far. ``match`` says how a word was found: 0 to 2 edits, ``STEM`` for a
    stem, ``NONE``."""

    terms: tuple[str, ...]
    stems: tuple[str, ...]
    nodes: list[dict] = field(default_factory=lambda: [{}], repr=False)
    budget: list[int] = field(default_factory=lambda: [-1], repr=False)  # edits allowed to the terms below a node
    ends: dict[int, int] = field(default_factory=dict, repr=False)  # node of a whole term: edits allowed to it
    stem_ends: set[int] = field(default_factory=set, repr=False)

    NONE, STEM = 9, 3

    def __post_init__(self) -> None:
        for word, stem in [*((t, False) for t in self.terms), *((s, True) for s in self.stems)]:
            at, allowed = 0, 0 if stem else edits_allowed(word)
            self.budget[0] = max(self.budget[0], allowed)
            for letter in word:
                if letter not in self.nodes[at]:
                    self.nodes[at][letter] = len(self.nodes)
                    self.nodes.append({})
                    self.budget.append(-1)
                at = self.nodes[at][letter]
                self.budget[at] = max(self.budget[at], allowed)
            if stem:
                self.stem_ends.add(at)
            else:
                self.ends[at] = allowed
        self.longest = max(map(len, self.terms), default=0) + MOST_EDITS
        self.forget()

    def forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.sets: list[dict[int, int]] = []
        self.numbers: dict[frozenset, int] = {}
        self.best: list[int] = []  # fewest edits to a term that ends in the state
        self.stemmed: list[bool] = []  # whether a stem ends in it
        self.seen: dict[str, None] = {}
        self.joined: dict[str, int] = {}  # words with signs inside, and how they were found
        self.hot: dict[str, int] = dict.fromkeys(QUOTES, self.NONE)  # words that count in a text, and how they were found
        self.seen.update(dict.fromkeys(QUOTES))
        self.start = self._number(self._skip({0: 0}))

    def look_up(self, word: str) -> None:
        """Remember how a word is found, or that it is not."""
        how = self.match(word)
        self.seen[word] = None
        if how <= self.STEM or word in REPORTING:
            self.hot[word] = how

    def found(self, word: str) -> int:
        if word not in self.seen:
            self.look_up(word)
        return self.hot.get(word, self.NONE)

    def words(self, run: str) -> list[str]:
        """The words of a run that digits or signs part. Neighbours of which none is found are one word, with the signs between them, if
        that is found: each sign is an edit."""
        pieces = SIGNS.split(run)
        alone = [self.found(word) <= self.STEM for word in pieces[::2]]
        out, k = [], 0
        while k < len(pieces):
            best, end = self.NONE, k + 1
            for last in range(k + 2, min(k + 2 * MOST_EDITS + 1, len(pieces)), 2):
                joined = "".join(pieces[k : last + 1])
                signs = sum(map(len, pieces[k + 1 : last : 2]))
                if signs > MOST_EDITS or len(joined) > self.longest or any(alone[k // 2 : last // 2 + 1]):
                    break
                if joined not in self.joined:
                    self.joined[joined] = self.match(joined)
                if self.joined[joined] < min(best, self.STEM):
                    best, end = self.joined[joined], last + 1
            out.append("".join(pieces[k:end]))
            if best < self.STEM:
                self.hot[out[-1]] = best
            k = end + 1
        return out

    def match(self, word: str) -> int:
        at, stem = self.start, False
        for letter in word:
            to = self.steps.get((at, letter))
            if to is None:
                to = self.steps[at, letter] = self._number(self._step(self.sets[at], letter))
            at = to
            stem = stem or self.stemmed[at]
            if not self.sets[at]:
                break
        best = self.best[at]
        return best if best == 0 or not stem else self.STEM

    def _number(self, held: dict[int, int]) -> int:
        key = frozenset(held.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(held)
            self.best.append(min((n for node, n in held.items() if n <= self.ends.get(node, -1)), default=self.NONE))
            self.stemmed.append(any(not n and node in self.stem_ends for node, n in held.items()))
        return self.numbers[key]

    def _step(self, held: dict[int, int], letter: str) -> dict[int, int]:
        out: dict[int, int] = {}

        def put(node: int, spent: int) -> None:
            if spent <= self.budget[node] and spent < out.get(node, 99):
                out[node] = spent

        for node, spent in held.items():
            put(node, spent + 1)  # a letter too many
            for other, child in self.nodes[node].items():
                put(child, spent + (other != letter))
        return self._skip(out)

    def _skip(self, held: dict[int, int]) -> dict[int, int]:
        """Add what is reached by letters that the word lacks."""
        todo = list(held)
        while todo:
            node = todo.pop()
            for child in self.nodes[node].values():
                spent = held[node] + 1
                if spent <= self.budget[child] and spent < held.get(child, 99):
                    held[child] = spent
                    todo.append(child)
        return held


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]  # of FEATURES, then the constant


def text_features(matcher: Matcher, text: str | None) -> list[float]:
    """``FEATURES`` of one whole text."""
    tokens = TOKEN.findall((text or "").lower())
    if len(matcher.seen) + len(matcher.joined) > KEPT_WORDS or len(matcher.sets) > KEPT_STATES:
        matcher.forget()
    fresh = set(tokens).difference(matcher.seen)  # of a dict, not of its keys: those would be gone through for every text
    runs = {token for token in fresh if SIGNS.search(token)}
    for word in fresh - runs:
        matcher.look_up(word)
    if runs:
        tokens = [word for token in tokens for word in (matcher.words(token) if token in runs else (token,))]
    places = [k for k, token in enumerate(tokens) if token in matcher.hot]
    counts, quoted, opened, reported = [0, 0, 0, 0], 0, False, -WINDOW - 1
    words = len(tokens) - sum(tokens[k] in QUOTES for k in places)
    for place in places:
        token = tokens[place]
        how = matcher.hot[token]
        if token in QUOTES:
            opened = not opened
        elif how > Matcher.STEM:
            reported = place
        elif place - reported <= WINDOW or opened and _closes(tokens, place):
            quoted += 1
        else:
            counts[how] += 1
    density = 100 * sum(counts) / words if words else 0.0
    return [float(np.log1p(sum(counts))), *np.log1p(counts), float(np.log1p(quoted)), float(np.log1p(density))]


def _closes(tokens: list[str], place: int) -> bool:
    """Whether a quotation mark follows soon enough for the one before to open a quotation."""
    return any(t in QUOTES for t in tokens[place + 1 : place + 1 + 4 * WINDOW])


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from ``labels`` (``doc_id, toxic``; rows with a null are passed over) of ``docs`` (``doc_id, text``).

    Of more than ``MAX_ROWS`` rows about so many are taken, by a hash of their ids, which is all that is broadcast. Both classes are
    taken at the same rate, so that shares of toxic texts are those of all labels at any size. Words and stems are counted
    over these by Spark, by the number of texts that hold them.
    """
    ship_package(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = save(known, "labelled")
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, known.count()))) < MAX_ROWS)
    rows = save(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "training")
    totals = {bool(k): n for k, n in rows.groupBy(F.col("toxic") == 1).count().collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        constant = float(np.log((n_toxic + 0.5) / (n_clean + 0.5)))
        return ToxicityModel((), (), (*[0.0] * len(FEATURES), constant))
    grams = rows.mapInPandas(_grams, "gram string, toxic long, clean long").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    share = n_toxic / (n_toxic + n_clean)
    n = F.col("t") + F.col("c")
    part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
    evidence = part(F.col("t"), share) + part(F.col("c"), 1 - share)
    strong = grams.withColumn("evidence", evidence).where((F.col("evidence") >= max(MIN_EVIDENCE, float(np.log(n_toxic + n_clean)))) & (F.col("t") >= MIN_SHARE * n))
    chosen = strong.orderBy(F.desc("evidence"), "gram").select("gram", "t").collect()  # words of the bounded sample
    terms, stems = _lexicon({g: t for g, t in chosen})
    plain = ToxicityModel(terms, stems, ())
    found = rows.mapInPandas(_featured(plain), ", ".join(f"{f} double" for f in FEATURES) + ", toxic long").toPandas()
    return ToxicityModel(terms, stems, _logistic(found[list(FEATURES)].to_numpy(), (found["toxic"] == 1).to_numpy(float)))


def _lexicon(texts_of: dict[str, int]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Terms and stems: a stem goes if one term makes up most of it or a shorter stem covers it. Terms that a stem covers stay, for
    their misspellings: a stem is matched without edits."""
    terms = {g: n for g, n in texts_of.items() if not g.endswith("*")}
    stems: list[str] = []
    for stem, n in sorted((g[:-1], n) for g, n in texts_of.items() if g.endswith("*")):
        most = max((m for term, m in terms.items() if term.startswith(stem)), default=0)
        if most < ONE_TERM * n and not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    return tuple(terms), tuple(stems)


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        toxic, clean = {}, {}
        for text, label in zip(batch["text"], batch["toxic"], strict=True):
            words = {w for w in WORD.findall((text or "").lower()) if len(w) >= 4}
            counts = toxic if label == 1 else clean
            for gram in words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}:
                counts[gram] = counts.get(gram, 0) + 1
        grams = list({**toxic, **clean})
        yield pd.DataFrame({"gram": grams, "toxic": [toxic.get(g, 0) for g in grams], "clean": [clean.get(g, 0) for g in grams]})


def _featured(model: ToxicityModel):
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(model.terms, model.stems)
        for batch in batches:
            out = pd.DataFrame([text_features(matcher, t) for t in batch["text"]], columns=list(FEATURES))
            yield out.assign(toxic=batch["toxic"].to_numpy())

    return features


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of a ridge logistic regression with a constant, by Newton steps over the bounded sample."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(round(v, 9)) for v in w)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where ``score`` is at least one half), replacing columns of these names.

    Whole texts are read, and nothing but texts. A null or empty text has no match and gets the score of that. Rows
    are judged one by one, so repeated rows are judged alike and an empty table gives an empty result. Scores are
    rounded to nine places.
    """
    ship_package(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher, weights = Matcher(model.terms, model.stems), np.array(model.weights)
        for texts in batches:
            x = np.array([[*text_features(matcher, t), 1.0] for t in texts]).reshape(len(texts), len(weights))
            yield pd.Series(np.round(1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))), 9))

    scored = docs.withColumn("score", score.asNondeterministic()("text"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
