"""Quality classifier: a generalised additive model with pairwise interactions.

Each text is measured (``FEATURES``), each measure is cut into bins, and the model is one lookup table for each feature and
one for each chosen pair of features. The tables are learned by cyclic boosting: the features take turns, and in its turn
each adds a shallow tree over its bins, a small step towards the residuals, so that no feature can take what another
explains. Pairs are ranked by how much a tree over two features lowers what the single features left over, and the best
are boosted in the same way. Several such models are learned, each by a task of its own from another part of the sample,
stopped where the rest of the sample no longer gains, and averaged. A score is a sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm.hashing import _text_bytes, word_hashes
from callweave.llm.support import free_name, save
from callweave.session import ship_package

MAX_ROWS = 40_000  # labelled documents that the model is fitted on; of more, about so many are taken by a hash of their ids
BINS = 32  # of a feature
PAIR_BINS = 8  # of either feature of a pair
PAIRS = 8  # interactions kept
BAGS = 8  # models that are averaged
ROUNDS, PAIR_ROUNDS, PATIENCE = 400, 150, 25  # turns of all features at most, and those without gain that end them
RATE = 0.1  # share of a tree's step that is taken
LEAST_ROWS = 10  # in a leaf
RIDGE = 1.0

GROUP_BYTES = 1 << 22  # bytes of texts measured together: bounds memory, never the result

FEATURES = (
    "log_words",
    "word_length",
    "word_length_spread",
    "longest_word",
    "upper",
    "digits",
    "symbols",
    "marks",
    "commas",
    "other_signs",
    "beyond_ascii",
    "words_a_line",
    "signed_words",
    "bare_words",
    "distinct_words",
    "distinct_pairs",
    "commonest_word",
    "stutters",
    "repeated_lines",
)


# --- features ----------------------------------------------------------------------------------------------


def _members(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _members("0123456789")
_SYMBOL = _members("#*$%&|<>")
_MARK = _members(".!?")
_COMMA = _members(",;:")
_OTHER = _members("\"'()[]{}@^~=+_/\\`-")
_BLANK = _members(" \t\n\x0b\x0c\r")
_INNER = np.zeros(256, bool)  # bytes that continue a code point
_INNER[0x80:0xC0] = True
_LETTER = _UPPER | _members("abcdefghijklmnopqrstuvwxyz")
_LETTER[0x80:] = True
_BEYOND = np.zeros(256, bool)
_BEYOND[0xC0:] = True


def text_features(texts: pa.Array) -> np.ndarray:
    """``FEATURES`` of each whole text, one row a text. A null text is measured as an empty one, all of whose features are 0."""
    rows = [_measured(group) for group in _groups(texts)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``GROUP_BYTES`` or a single text."""
    _, offsets = _text_bytes(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield texts.slice(first, last - first)
        first = last


def _measured(texts: pa.Array) -> np.ndarray:
    data, offsets = _text_bytes(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    count = len(texts)

    def per_text(flags: np.ndarray, bounds: np.ndarray = offsets) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)

    upper, digits, symbols, marks, commas, others, beyond = (
        per_text(table[data]) for table in (_UPPER, _DIGIT, _SYMBOL, _MARK, _COMMA, _OTHER, _BEYOND)
    )
    word = ~_BLANK[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]  # a text's end also ends a word
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    at = np.searchsorted(starts, offsets)  # the words of text k are at[k]:at[k + 1]
    points = np.concatenate([[0], np.cumsum(~_INNER[data], dtype=np.int64)])
    length = (points[ends] - points[starts]).astype(np.float64)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    has_letter = letters[ends] > letters[starts]
    signs = np.concatenate([[0], np.cumsum((_SYMBOL | _OTHER)[data], dtype=np.int64)])
    signed = signs[ends] > signs[starts]

    n = np.diff(at).astype(np.float64)
    some = np.maximum(n, 1)
    chars = per_text(word & ~_INNER[data])
    share = np.maximum(chars, 1)
    mean = per_text(length, at) / some
    spread = np.sqrt(np.maximum(per_text(length * length, at) / some - mean * mean, 0))
    longest = np.zeros(count)
    np.maximum.at(longest, np.repeat(np.arange(count), np.diff(at)), length)

    hashes, hashed_at = word_hashes(texts)
    owner = np.repeat(np.arange(count), np.diff(hashed_at))
    distinct, commonest, _ = _spectrum(owner, hashes, count)
    paired = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    both = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[paired] if len(owner) else hashes
    distinct_pairs, _, _ = _spectrum(owner[1:][paired] if len(owner) else owner, both, count)
    same = (hashes[1:] == hashes[:-1])[paired] if len(owner) else np.zeros(0, bool)
    stutters = np.bincount(owner[1:][paired], weights=same, minlength=count) if len(owner) else np.zeros(count)
    lines, repeated = _lines(data, offsets, starts, hashes)

    return np.column_stack(
        [
            np.log1p(n),
            mean,
            spread,
            np.log1p(longest),
            upper / share,
            digits / share,
            symbols / share,
            marks / some,
            commas / some,
            others / some,
            beyond / share,
            n / np.maximum(lines, 1),
            per_text(signed, at) / some,
            per_text(~has_letter, at) / some,
            distinct / some,
            distinct_pairs / np.maximum(n - 1, 1),
            commonest / some,
            stutters / np.maximum(n - 1, 1),
            repeated / np.maximum(lines, 1),
        ]
    ).round(9)


def _spectrum(owner: np.ndarray, values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner the number of distinct values, the occurrences of its commonest one, and the values that are repeats."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    opens = np.ones(len(owner), bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    at = np.flatnonzero(opens)
    most = np.zeros(count)
    np.maximum.at(most, owner[at], np.diff(np.append(at, len(owner))))
    distinct = np.bincount(owner[at], minlength=count).astype(np.float64)
    return distinct, most, np.bincount(owner, minlength=count) - distinct


def _lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them whose words another line before them has."""
    count = len(offsets) - 1
    if not len(starts):
        return np.zeros(count), np.zeros(count)
    breaks = np.concatenate([[0], np.cumsum(data == 10, dtype=np.int64)])
    owner = np.searchsorted(offsets, starts, "right") - 1
    line = breaks[starts]
    opens = np.ones(len(starts), bool)
    opens[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(opens)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.append(at, len(starts))))
    scale = np.cumprod(np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    summed = np.add.reduceat(hashes * scale[place], at)
    lines = np.bincount(owner[at], minlength=count).astype(np.float64)
    return lines, _spectrum(owner[at], summed, count)[2]


# --- the model ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AdditiveModel:
    """Cuts between the bins of each feature, a table for each, and the pairs with their cuts and tables."""

    cuts: tuple[tuple[float, ...], ...]
    tables: tuple[tuple[float, ...], ...]
    pairs: tuple[tuple[int, int], ...]
    pair_cuts: tuple[tuple[float, ...], ...]
    pair_tables: tuple[tuple[tuple[float, ...], ...], ...]
    constant: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features: bins, table entries, a sum."""
        total = np.full(len(x), self.constant)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables)):
            total += np.asarray(table)[np.searchsorted(cuts, x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], "right") for pair in self.pairs for k in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += np.asarray(table)[coarse[i], coarse[j]]
        return np.round(1 / (1 + np.exp(-np.clip(total, -30, 30))), 9)


def fit_quality(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    """Learn from ``labels`` (``doc_id, quality``; rows with a null are passed over) of ``docs`` (``doc_id, text``).

    Of more than ``MAX_ROWS`` labelled ids about so many are taken, by a hash of the id; that bounds what is broadcast and
    fitted. Both classes are taken at one rate. Of rows that share an id one counts, the one with the least features. Without
    rows of both labels the model is a constant.
    """
    spark = docs.sparkSession
    ship_package(spark)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = save(known, "labelled")
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, known.count()))) < MAX_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    measured = rows.select("doc_id", "quality", _features()("text").alias("features"))
    found = measured.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("features").alias("features")).orderBy("doc_id").toPandas()
    y = (found["quality"] == 1).to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return AdditiveModel(((),) * len(FEATURES), ((0.0,),) * len(FEATURES), (), ((),) * len(FEATURES), (), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    return fit_additive(spark, np.array(found["features"].tolist()), y)


def fit_additive(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of the bounded rows ``x`` with labels ``y``. Each bag is boosted by a task of its own, and takes no draw that
    depends on the cluster, so reruns agree."""
    cuts, coarse = [_cuts(x[:, k], BINS) for k in range(x.shape[1])], [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    fine_bins = np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)])
    pair_bins = np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)])
    constant = float(np.log(y.mean() / (1 - y.mean())))
    shared = spark.sparkContext.broadcast((fine_bins, y))

    def mains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, label = shared.value
        keys = [bins[:, k] for k in range(bins.shape[1])]
        for batch in batches:
            for bag in batch["id"]:
                tables = boost(keys, [(BINS,)] * len(keys), label, np.full(len(label), constant), int(bag), ROUNDS)
                yield pd.DataFrame({"bag": [bag], "tables": [np.concatenate(tables)]})

    tables = _averaged(spark, mains, "bag long, tables array<double>").reshape(-1, BINS)
    base = constant + sum(table[fine_bins[:, k]] for k, table in enumerate(tables))
    pairs = best_pairs(pair_bins, y, base)
    again = spark.sparkContext.broadcast((pair_bins, y, base))

    def seconds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, label, start = again.value
        keys = [bins[:, i] * PAIR_BINS + bins[:, j] for i, j in pairs]
        for batch in batches:
            for bag in batch["id"]:
                tables = boost(keys, [(PAIR_BINS, PAIR_BINS)] * len(keys), label, start, int(bag), PAIR_ROUNDS)
                yield pd.DataFrame({"bag": [bag], "tables": [np.concatenate(tables)]})

    pair_tables = _averaged(spark, seconds, "bag long, tables array<double>").reshape(-1, PAIR_BINS, PAIR_BINS) if pairs else []
    return AdditiveModel(
        tuple(tuple(c.tolist()) for c in cuts),
        tuple(tuple(t[: len(c) + 1].tolist()) for t, c in zip(tables, cuts)),
        tuple(pairs),
        tuple(tuple(c.tolist()) for c in coarse),
        tuple(tuple(tuple(row) for row in t.tolist()) for t in pair_tables),
        constant,
    )


def _averaged(spark: SparkSession, work, schema: str) -> np.ndarray:
    """Mean of the tables of all bags: ``BAGS`` rows of a fixed size."""
    found = spark.range(BAGS).repartition(BAGS, "id").mapInPandas(work, schema).toPandas().sort_values("bag")
    return np.mean(np.stack(found["tables"].map(np.asarray).to_list()), axis=0).round(9)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Distinct quantiles that part the sample into at most ``bins`` bins. A value equal to a cut is above it."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher"))


def boost(
    keys: list[np.ndarray], shapes: list[tuple[int, ...]], y: np.ndarray, start: np.ndarray, bag: int, rounds: int
) -> list[np.ndarray]:
    """One flat table for each of ``keys`` (the cell of each row), by cyclic boosting from the log-odds ``start``.

    The bag learns from about five rows in six and keeps the tables of the round after which the others have the least loss.
    """
    learn = np.random.Generator(np.random.PCG64(1000 + bag)).random(len(y)) < 5 / 6
    tables, total = [np.zeros(int(np.prod(shape))) for shape in shapes], start.copy()
    kept, least, since = [t.copy() for t in tables], np.inf, 0
    own = [key[learn] for key in keys]
    for _ in range(rounds):
        for k, shape in enumerate(shapes):
            p = 1 / (1 + np.exp(-total[learn]))
            step = RATE * shallow_tree(
                np.bincount(own[k], weights=y[learn] - p, minlength=len(tables[k])).reshape(shape),
                np.bincount(own[k], weights=p * (1 - p), minlength=len(tables[k])).reshape(shape),
                np.bincount(own[k], minlength=len(tables[k])).reshape(shape),
            )
            tables[k] += step
            total += step[keys[k]]
        rest = total[~learn] if not learn.all() else total
        label = y[~learn] if not learn.all() else y
        loss = float(np.mean(np.logaddexp(0, rest) - label * rest)) if len(rest) else 0.0
        since += 1
        if loss < least - 1e-6:
            kept, least, since = [t.copy() for t in tables], loss, 0
        elif since >= PATIENCE:
            break
    return kept


def shallow_tree(gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The Newton steps of a tree with up to three leaves over the bins of a feature, or up to four over those of a pair, as a flat
    table. Along one axis the best cut is taken, and then one more in its better half; over two axes each half is cut
    along the other axis, starting from the axis that gains more."""
    if gradient.ndim == 1:
        table, (cut, _) = np.zeros(len(gradient)), _best_cut(gradient, curve, rows)
        halves = [slice(0, cut), slice(cut, None)]
        again = [_best_cut(gradient[h], curve[h], rows[h]) for h in halves] if cut else [(0, 0.0), (0, 0.0)]
        better = int(again[1][1] > again[0][1])
        for side, half in enumerate(halves):
            leaves = [half]
            if again[side][0] and side == better:
                middle = half.start + again[side][0]
                leaves = [slice(half.start, middle), slice(middle, half.stop)]
            for leaf in leaves:
                table[leaf] = _step(gradient[leaf], curve[leaf])
        return table
    tables = []
    for axis in (0, 1):
        g, h, n = (a if axis == 0 else a.T for a in (gradient, curve, rows))
        table, gain = np.zeros(g.shape), 0.0
        cut, first = _best_cut(g.sum(axis=1), h.sum(axis=1), n.sum(axis=1))
        gain += first
        for half in (slice(0, cut), slice(cut, None)):
            if not len(g[half]):
                continue
            column = g[half].sum(axis=0), h[half].sum(axis=0), n[half].sum(axis=0)
            middle, more = _best_cut(*column)
            gain += more
            for leaf in (slice(0, middle), slice(middle, None)):
                table[half, leaf] = _step(column[0][leaf], column[1][leaf])
        tables.append((gain, table if axis == 0 else table.T))
    return (tables[0] if tables[0][0] >= tables[1][0] else tables[1])[1].ravel()


def _step(gradient: np.ndarray, curve: np.ndarray) -> float:
    return float(gradient.sum() / (curve.sum() + RIDGE))


def _best_cut(gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
    """Where two leaves gain most over one, and what they gain; 0 where no cut leaves ``LEAST_ROWS`` on both sides."""
    if len(gradient) < 2:
        return 0, 0.0
    g, h, n = np.cumsum(gradient), np.cumsum(curve), np.cumsum(rows)
    left = g[:-1] ** 2 / (h[:-1] + RIDGE)
    right = (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + RIDGE)
    gain = left + right - g[-1] ** 2 / (h[-1] + RIDGE)
    gain = np.where((n[:-1] >= LEAST_ROWS) & (n[-1] - n[:-1] >= LEAST_ROWS), gain, 0.0)
    best = int(np.argmax(gain))
    return (best + 1, float(gain[best])) if gain[best] > 0 else (0, 0.0)


def best_pairs(bins: np.ndarray, y: np.ndarray, total: np.ndarray) -> list[tuple[int, int]]:
    """The ``PAIRS`` pairs of features whose four-leaf tree lowers the loss most beyond the single features."""
    p = 1 / (1 + np.exp(-total))
    ranked = []
    for i in range(bins.shape[1]):
        for j in range(i + 1, bins.shape[1]):
            cell = bins[:, i] * PAIR_BINS + bins[:, j]
            shape = (PAIR_BINS, PAIR_BINS)
            g = np.bincount(cell, weights=y - p, minlength=PAIR_BINS**2)
            h = np.bincount(cell, weights=p * (1 - p), minlength=PAIR_BINS**2)
            step = shallow_tree(g.reshape(shape), h.reshape(shape), np.bincount(cell, minlength=PAIR_BINS**2).reshape(shape))
            ranked.append((-float((step * g - step * step * h / 2).sum()), (i, j)))
    return sorted(pair for gain, pair in sorted(ranked)[:PAIRS] if gain < -1e-9)


# --- scoring -----------------------------------------------------------------------------------------------


def _features():
    @F.arrow_udf("array<double>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = text_features(texts)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x.ravel(), pa.float64()))

    return measure.asNondeterministic()


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, the probability of label 1) and ``predicted`` (1 where ``score`` is at least ``threshold``),
    replacing columns of these names.

    Whole texts are read, and nothing but texts. A null text is scored as an empty one. Rows are judged one by one, so
    repeated rows are judged alike and an empty table gives an empty result. Scores are rounded to nine places.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.scores(text_features(texts)), pa.float64())

    inner = free_name(docs, "scored")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    scored = docs.withColumn(inner, score.asNondeterministic()("text"))
    return scored.select(*kept, F.col(inner).alias("score"), (F.col(inner) >= threshold).cast("int").alias("predicted"))
