"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of words that repeats with a smallest period ``q``, is at least ``2 q`` long and cannot be extended to
either side. The dictionary names every factor of 1, 2, 4, ... words: two places get one name exactly if the words there
agree. A run of period ``q`` with ``F <= q < 2 F`` starts with a factor of ``F`` words that occurs again ``q`` words on, so
occurrences of one name at a distance of ``F`` to ``2 F`` propose all its periods. Occurrences closer than ``F / 2`` form
arithmetic progressions. Inside one, each is preceded by the same word, so a stretch that cannot be extended to the left
has the head of a progression at one end of the proposal: at most a handful of proposals a place and length, also where
one word fills a text. Two names tell whether a proposal is a square, and the dictionary extends it to the right, longest
factors first.

All texts of a task's batch share one dictionary, in arrays, and names never cross a text.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.session import ship_package

MIN_LENGTH = 12  # words of the shortest run reported
BATCH_WORDS = 1 << 18  # words that share a dictionary: bounds memory, never the result

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND_ARROW = pa.struct([("runs", pa.list_(_RUN_ARROW)), ("collapsed", pa.string())])


def collapse_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``runs``, an array of ``RUN`` by start and period, and ``collapsed``, replacing columns of these names.

    Words are runs of characters other than the six ASCII blanks, compared as they are written and numbered from 0.
    ``runs`` holds every run of at least ``min_length`` words. ``collapsed`` is the words that no run covers after its first
    period, joined by one space. A null, empty or blank text has no run and an empty ``collapsed``. Rows are worked on one
    by one, so repeated rows get equal results and an empty table gives an empty result; nothing is shuffled. All of a
    text's words are in memory at once with their names, some dozens of bytes a word and length that repeats.
    """
    ship_package(docs.sparkSession)

    @F.arrow_udf(f"runs array<{RUN}>, collapsed string")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [_found(words, min_length) for words in _word_lists(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _FOUND_ARROW)

    inner = "found"
    while inner in (c.lower() for c in docs.columns):
        inner += "_"
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    named = docs.withColumn(inner, find.asNondeterministic()(F.col(text)))
    return named.select(*kept, f"{inner}.runs", f"{inner}.collapsed")


def _word_lists(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    """The words of each text, in groups of about ``BATCH_WORDS`` words or a single text."""
    group, size = [], 0
    for text in texts.cast(pa.large_string()).cast(pa.large_binary()):
        words = (text.as_py() or b"").split()  # bytes are split at the six ASCII blanks
        if group and size + len(words) > BATCH_WORDS:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _found(texts: list[list[bytes]], min_length: int) -> pa.Array:
    flat = list(itertools.chain.from_iterable(texts))
    bounds = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, end, period = text_runs(codes, bounds, min_length)
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, end, -1)
    keep = np.cumsum(covered)[:-1] == 0
    collapsed = []
    for words, lo, hi in zip(texts, bounds, bounds[1:]):
        own = keep[lo:hi]
        collapsed.append(b" ".join(words if own.all() else itertools.compress(words, own)).decode())
    owner = np.searchsorted(bounds, start, "right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(x, pa.int64()) for x in (start - bounds[owner], end - start, period)], fields=list(_RUN_ARROW)
    )
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
    return pa.StructArray.from_arrays([runs, pa.array(collapsed, pa.string())], fields=list(_FOUND_ARROW))


def text_runs(codes: np.ndarray, bounds: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, by start and period, of the texts ``codes[bounds[k]:bounds[k + 1]]``."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    names: list[np.ndarray] = []  # by level; -1 where no other place of the text agrees
    starts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    places, keys = np.arange(len(codes)), owner * (int(codes.max(initial=0)) + 1) + codes
    factor = 1
    while len(places):
        name, places, group = _named(len(codes), places, keys)
        names.append(name)
        i, j = _proposals(places, group, factor, len(codes))
        at_edge = (i == 0) | (owner[i - 1] != owner[i])
        before = names[0][i - 1]
        opens = at_edge | (before != names[0][j - 1]) | (before < 0)
        i, j = i[opens], j[opens]
        last = 2 * j - i - factor  # a square if the factors that end its two halves agree
        fits = last < len(codes)
        i, j, last = i[fits], j[fits], last[fits]
        square = (name[last] >= 0) & (name[last] == name[j - factor])
        starts.append(i[square])
        seconds.append(j[square])

        places = np.sort(places)
        places = places[places + factor < len(codes)]
        right = name[places + factor]
        both = (right >= 0) & (owner[places] == owner[np.minimum(places + factor, len(codes) - 1)])
        places, right = places[both], right[both]
        keys = name[places].astype(np.int64) * len(codes) + right
        factor *= 2
    start, second = np.concatenate(starts), np.concatenate(seconds)
    period = second - start
    end = second + _common(names, start, second)
    long_enough = end - start >= min_length
    start, end, period = start[long_enough], end[long_enough], period[long_enough]
    # multiples of a period cover the same stretch: the smallest stays
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _named(n: int, places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all ``n`` places, the places that share theirs by name and place, and the names of these."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(opens) - 1
    shared = np.bincount(group)[group] > 1
    places, group = places[shared], group[shared]
    name = np.full(n, -1, np.int32)
    name[places] = group
    return name, places, group


def _proposals(places: np.ndarray, group: np.ndarray, factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with one name, ``factor`` to ``2 * factor`` apart, of which one heads a progression."""
    key = group.astype(np.int64) * (4 * n) + places
    head = np.ones(len(key), bool)
    head[1:] = 2 * (key[1:] - key[:-1]) > factor
    heads = np.flatnonzero(head)
    lo, hi = np.searchsorted(key, key[heads] + factor), np.searchsorted(key, key[heads] + 2 * factor)
    first, ahead = _spread(heads, lo, hi)
    lo, hi = np.searchsorted(key, key[heads] - 2 * factor + 1), np.searchsorted(key, key[heads] - factor + 1)
    second, back = _spread(heads, lo, hi)
    inner = ~head[back]  # pairs of two heads are there already
    return places[np.concatenate([first, back[inner]])], places[np.concatenate([ahead, second[inner]])]


def _spread(owners: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner with every number of its range ``lo:hi``."""
    size = hi - lo
    some = size > 0
    owners, lo, size = owners[some], lo[some], size[some]
    before = np.cumsum(size) - size
    return np.repeat(owners, size), np.arange(size.sum()) + np.repeat(lo - before, size)


def _common(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from ``i`` and ``j`` on. No factor longer than the longest named one occurs twice."""
    length = np.zeros(len(i), np.int64)
    for level in range(len(names) - 1, -1, -1):
        name = names[level]
        right = j + length
        inside = right < len(name)
        right = np.where(inside, right, 0)
        agree = inside & (name[right] >= 0) & (name[right] == name[i + length])
        length[agree] += 1 << level
    return length
