"""The catalogue as an inverted index, and its use on one Arrow batch of sentences.

A join on terms would give the same sums, but as rows: a common word pairs nearly every sentence with nearly every
topic. Here those pairs are added up in arrays within the task and only the matches come out as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

TILE_CELLS = 50_000  # sums and postings held at a time: a few arrays of this size stay in the processor's cache

MATCH_TYPE = "array<struct<topic_no: bigint, dot: bigint, sentence_sq: bigint, topic_sq: bigint>>"
_MATCH_FIELDS = ("topic_no", "dot", "sentence_sq", "topic_sq")


@dataclass(frozen=True)
class TermIndex:
    """Postings of term ``i`` are entries ``starts[i]:starts[i + 1]`` of ``column`` and ``tf``."""

    vocabulary: pa.Array
    starts: np.ndarray
    column: np.ndarray
    tf: np.ndarray
    topic_no: np.ndarray
    topic_sq: np.ndarray

    @staticmethod
    def build(postings: pd.DataFrame) -> TermIndex:
        """From rows ``topic_no, term, topic_tf, topic_sq``."""
        by_term = postings.sort_values(["term", "topic_no"])
        vocabulary, per_term = np.unique(by_term["term"].to_numpy(str), return_counts=True)
        topics = postings.groupby("topic_no")["topic_sq"].first().sort_index()
        return TermIndex(
            pa.array(vocabulary.tolist(), pa.string()),
            np.concatenate([[0], np.cumsum(per_term)]).astype(np.int64),
            np.searchsorted(topics.index.to_numpy(np.int64), by_term["topic_no"].to_numpy(np.int64)).astype(np.int32),
            by_term["topic_tf"].to_numpy(np.float64),
            topics.index.to_numpy(np.int64),
            topics.to_numpy(np.int64),
        )

    def matches(self, term_lists: pa.Array, threshold: tuple[int, int]) -> pa.Array:
        """For each term list the topics with cosine above ``p/q``.

        Sums of counts are whole numbers, exact also as floats. A comparison of floats with some slack leaves out most
        pairs, and the rest is compared as integers.
        """
        p, q = threshold
        rows, codes, counts, words = _term_counts(term_lists)
        squares = np.bincount(rows, weights=counts * counts, minlength=len(term_lists)).astype(np.int64)
        slack = 1 - 1e-9
        least, topic_scale = slack * p / q * np.sqrt(squares), 1 / np.sqrt(self.topic_sq)
        ids = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)[codes]
        known = ids >= 0
        rows, ids, counts = rows[known], ids[known], counts[known]
        sizes = self.starts[ids + 1] - self.starts[ids]

        found: list[tuple[np.ndarray, ...]] = []
        width = len(self.topic_no)
        for first, last, lo, hi in _tiles(rows, sizes, len(term_lists), width):
            entry = _ranges(self.starts[ids[lo:hi]], sizes[lo:hi])
            cell = np.repeat((rows[lo:hi] - first) * width, sizes[lo:hi]) + self.column[entry]
            product = np.repeat(counts[lo:hi], sizes[lo:hi]) * self.tf[entry]
            dots = np.bincount(cell, weights=product, minlength=(last - first) * width).reshape(last - first, width)
            row, col = np.nonzero(dots * topic_scale > least[first:last, None])
            dot, square, topic_sq = dots[row, col].astype(np.int64), squares[row + first], self.topic_sq[col]
            above = q * q * dot * dot > p * p * square * topic_sq
            row, col = row[above], col[above]
            found.append((row + first, self.topic_no[col], dot[above], square[above], topic_sq[above]))
        return _as_lists(found, len(term_lists))


def _term_counts(term_lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Rows, term codes and counts of the distinct terms of each list, ordered by row; and the coded terms."""
    rows = pc.list_parent_indices(term_lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(term_lists).dictionary_encode()
    base = max(1, len(coded.dictionary))
    keys, counts = np.unique(rows * base + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return keys // base, keys % base, counts.astype(np.float64), coded.dictionary


def _tiles(rows: np.ndarray, sizes: np.ndarray, total: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """Row ranges ``first:last`` with their entries ``lo:hi``, each within ``TILE_CELLS`` or a single row."""
    postings = np.concatenate([[0], np.cumsum(np.bincount(rows, weights=sizes, minlength=total))])
    step = max(1, TILE_CELLS // max(1, width))
    first = 0
    while first < total:
        last = int(np.searchsorted(postings, postings[first] + TILE_CELLS, side="right")) - 1
        last = min(max(last, first + 1), first + step, total)
        lo, hi = np.searchsorted(rows, (first, last))
        if hi > lo:
            yield first, last, int(lo), int(hi)
        first = last


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0]+1, ...`` for ``sizes[0]`` entries, then the same for the next one."""
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) + np.repeat(starts - before, sizes)


def _as_lists(found: list[tuple[np.ndarray, ...]], total: int) -> pa.Array:
    columns = [np.concatenate(parts) for parts in zip(*found)] if found else [np.empty(0, np.int64)] * 5
    offsets = np.concatenate([[0], np.cumsum(np.bincount(columns[0], minlength=total))]).astype(np.int32)
    entries = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns[1:]], names=list(_MATCH_FIELDS))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)
