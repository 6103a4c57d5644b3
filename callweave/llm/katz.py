"""Katz backoff language model of words.

A word pair seen ``r`` times in training keeps ``d(r) * r`` of its context's count, with Good-Turing discounts ``d``; what the
discounts free goes to the words not seen after the context, in proportion to their single-word probability. The backoff
weight of a context is the quotient of what is left over by what those words have, so the probabilities after every
context add up to one. Single words have add-half probabilities with one unknown word.

Texts are cut into blocks of documents. A block keeps its word hashes in the shared folder and asks for counts by its distinct
words and word pairs only: the questions are dealt out by hash to tasks that each hold one part of the count table, are
answered there from all blocks, and return to their block, which scores its documents token by token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.hashing import mix, word_hashes
from callweave.llm.support import save
from callweave.session import ship_package

BLOCK_BYTES = 4 << 20  # of text in a block
KEYS_PER_PART = 1 << 19  # distinct keys of blocks that a part of a count table takes in, about
DISCOUNTED = 5  # counts above this are not discounted
END, START = np.uint64(0xE4D0E4D0E4D0E4D1), np.uint64(0x57A2757A2757A277)  # stand for the end and the start of a text


@dataclass(frozen=True)
class Totals:
    tokens: int  # training tokens, ends included
    distinct: int  # distinct training tokens
    texts: int  # training texts
    discounts: tuple[float, ...]  # of the counts 1 to DISCOUNTED

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))

    def seen(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        d = np.concatenate(([0.0], self.discounts, [1.0]))
        return d[np.minimum(count, DISCOUNTED + 1)] * count


def good_turing(of_count: dict[int, int]) -> tuple[float, ...]:
    """Katz's discounts for 1 to ``DISCOUNTED`` from the number of pairs of each count. Where the numbers do not support one
    (some count is missing, or the discount falls outside 0 to 1), one half is taken off the count."""
    n = [0, *(of_count.get(r, 0) for r in range(1, DISCOUNTED + 2))]
    k = DISCOUNTED
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and n[r + 1] and tail < 1 else 0.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return tuple(out)


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (``doc_id, text, held_out``).

    Learns from the rows with ``held_out`` false (null: false) and scores all. Tokens are words between ASCII blanks, A-Z lower-cased, and one end for each
    text, so a null, empty or blank text has one token. ``base_score`` adds up single-word log10 probabilities, ``score`` those of
    the model. Repeated rows count each time; ids are only carried along. Without training text every token has
    probability one. An empty table gives an empty result; other columns are ignored.

    Words and pairs are told apart by 64-bit hashes. A context all of whose followers are too frequent to be discounted
    sets aside one count for the others.
    """
    ship_package(docs.sparkSession)
    held = F.coalesce("held_out", F.lit(False)).alias("held_out")
    blocks = docs.select("doc_id", "text", held).mapInArrow(_block, _BLOCKS).withColumn("block", F.monotonically_increasing_id())
    blocks = save(blocks, "blocks")
    sizes = blocks.agg(F.sum("n_words"), F.sum("n_pairs"), F.sum("n_training")).first()
    word_parts, pair_parts = (max(1, math.ceil((n or 0) / KEYS_PER_PART)) for n in sizes[:2])
    text = ["block", "lengths", "tokens", "words", "learned"]

    # single words
    answers = save(_counted(blocks.select(text), _ask_words(word_parts)), "words")
    tokens, distinct = answers.agg(F.sum("total"), F.sum("distinct")).first()
    known = blocks.select(text).join(_return(answers, "word_answers"), "block")

    # pairs of words
    answers = save(_counted(blocks.select(text), _ask_pairs(pair_parts)), "pairs")
    of_count = answers.select(F.posexplode("of_count").alias("r", "n")).groupBy("r").agg(F.sum("n")).collect()
    totals = Totals(tokens or 0, distinct or 0, sizes[2] or 0, good_turing({r + 1: n for r, n in of_count}))
    known = known.join(_return(answers, "pair_answers"), "block")

    # what is left over after each context, from every distinct pair once
    asked = known.mapInArrow(_ask_contexts(totals, word_parts), _MASSES)
    answers = save(asked.groupBy("part").applyInPandas(_answer_contexts, "part int, block long, weight binary, more binary"), "contexts")
    weights = answers.groupBy("block").agg(F.collect_list(F.struct("part", "weight", "more")).alias("weights"))
    full = known.join(weights, "block").join(blocks.select("block", "doc_ids", "held_out"), "block")
    return full.mapInArrow(_scorer(totals), _SCORES)


_BLOCKS = (
    "doc_ids array<bigint>, held_out array<boolean>, lengths binary, tokens binary, words binary, learned binary, n_words long, "
    "n_pairs long, n_training long"
)
_ASKED = "part int, block long, keys binary, counts binary"
_ANSWERS = "part int, block long, counts binary, owned binary, total long, distinct long, of_count array<bigint>"
_MASSES = "part int, block long, keys binary, mass binary, share binary, counts binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text").cast(pa.large_string()).fill_null("")
        ends = np.cumsum([0, *pa.compute.binary_length(text).to_numpy()])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1)
            yield _one_block(batch.slice(at, to - at))
            at = to


def _one_block(batch: pa.RecordBatch) -> pa.RecordBatch:
    hashes, at = word_hashes(batch.column("text"))
    held_out = np.asarray(batch.column("held_out").to_pylist(), bool)
    lengths = np.diff(at) + 1
    stream = np.full(len(hashes) + len(lengths), END, np.uint64)
    inner = np.ones(len(stream), bool)
    inner[np.cumsum(lengths) - 1] = False
    stream[inner] = hashes
    words, tokens, counts = np.unique(np.append(stream, START), return_inverse=True, return_counts=True)
    often = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
    rank = np.empty_like(often)
    rank[often] = np.arange(len(often))
    words, tokens = words[often], rank[tokens[:-1]]
    row = {
        "doc_ids": batch.column("doc_id").to_pylist(), "held_out": held_out.tolist(), "lengths": pack(lengths.astype(np.uint32)),
        "tokens": pack(tokens.astype(np.uint32)), "words": words.tobytes(), "learned": (~held_out).tobytes(), "n_words": len(words),
        "n_pairs": len(tokens), "n_training": int((~held_out).sum()),
    }
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first bytes of all first: the upper ones are mostly equal."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield {c: batch.column(c)[r].as_py() for c in batch.schema.names}
            pa.default_memory_pool().release_unused()


@dataclass
class _Text:
    """What a block's row says, worked out again wherever it is needed rather than stored."""

    words: np.ndarray  # hashes of the block's distinct words, sorted
    tokens: np.ndarray  # of all texts one after the other, as places in ``words``
    lengths: np.ndarray
    learned: np.ndarray  # for each token

    @classmethod
    def of(cls, row: dict) -> _Text:
        lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        learned = np.repeat(np.frombuffer(row["learned"], bool), lengths)
        words = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return cls(words[order], place[unpack(row["tokens"], np.uint32)], lengths, learned)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.learned], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct pairs, sorted; their left and right words; the pair of each token."""
        left = np.empty_like(self.tokens)
        left[1:] = self.tokens[:-1]
        left[np.cumsum(self.lengths) - self.lengths] = np.searchsorted(self.words, START)
        with np.errstate(over="ignore"):
            keys, first, place = np.unique(
                mix(mix(self.words)[left] + self.words[self.tokens]), return_index=True, return_inverse=True
            )
        return keys, left[first], self.tokens[first], place


def _cuts(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """``part, from, to`` of sorted keys; every block cuts its keys alike, so answers need not repeat them."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(part, np.arange(parts + 1))
    return [(p, int(ends[p]), int(ends[p + 1])) for p in range(parts) if ends[p] < ends[p + 1]]


def _gaps(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def _questions(block: int, keys: np.ndarray, parts: int, **fields: np.ndarray) -> pa.RecordBatch:
    cuts = _cuts(keys, parts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _, _ in cuts], pa.int32()), pa.array([block] * len(cuts), pa.int64()),
            pa.array([_gaps(keys[a:b]) for _, a, b in cuts], pa.binary()),
            *(pa.array([pack(v[a:b]) for _, a, b in cuts], pa.binary()) for v in fields.values()),
        ],
        names=["part", "block", "keys", *fields],
    )


def _ask_words(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            text = _Text.of(row)
            yield _questions(row["block"], text.words, parts, counts=text.word_counts().astype(np.uint32))

    return ask


def _ask_pairs(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            text = _Text.of(row)
            keys, _, _, place = text.pairs()
            counts = np.bincount(place[text.learned], minlength=len(keys))
            yield _questions(row["block"], keys, parts, counts=counts.astype(np.uint32))

    return ask


def _counted(blocks: DataFrame, ask) -> DataFrame:
    return blocks.mapInArrow(ask, _ASKED).groupBy("part").applyInPandas(_answer, _ANSWERS)


def _answer(group: pd.DataFrame) -> pd.DataFrame:
    """Total counts of the keys of one part, for each block that asked. A key is owned by one of the blocks that ask for it."""
    keys = [_keys(k) for k in group["keys"]]
    cuts = np.cumsum([0, *map(len, keys)])
    held, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    given = np.concatenate([unpack(c, np.uint32) for c in group["counts"]])
    totals = np.bincount(place, weights=given, minlength=len(held)).astype(np.int64)
    owned = np.zeros(len(given), bool)
    owned[first] = True
    small = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
    answer = totals[place].astype(np.uint32)
    n = len(keys)
    return pd.DataFrame(
        {
            "part": group["part"], "block": group["block"], "counts": [pack(answer[cuts[i] : cuts[i + 1]]) for i in range(n)],
            "owned": [np.packbits(owned[cuts[i] : cuts[i + 1]]).tobytes() for i in range(n)],
            "total": [int(totals.sum()) if not i else 0 for i in range(n)], "distinct": [int((totals > 0).sum()) if not i else 0 for i in range(n)],
            "of_count": [small.tolist() if not i else [] for i in range(n)],
        }
    )


def _return(answers: DataFrame, name: str) -> DataFrame:
    """The answers of all parts, gathered by the block that asked: as many numbers as the block has distinct keys."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "counts", "owned")).alias(name))


def _joined(answers: list[dict], field: str, kind) -> np.ndarray:
    """One number for each of the block's sorted keys."""
    return np.concatenate([unpack(a[field], kind) for a in sorted(answers, key=lambda a: a["part"])])


def _owned(answers: list[dict]) -> np.ndarray:
    ordered = sorted(answers, key=lambda a: a["part"])
    return np.concatenate([np.unpackbits(np.frombuffer(a["owned"], np.uint8))[: len(unpack(a["counts"], np.uint32))] for a in ordered]).astype(bool)


def _ask_contexts(totals: Totals, parts: int):
    """For the pairs a block owns, by context: the discounted counts and the single-word probability of what was seen there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            text = _Text.of(row)
            _, left, right, _ = text.pairs()
            seen = _joined(row["pair_answers"], "counts", np.uint32)
            own = _owned(row["pair_answers"]) & (seen > 0)
            counts = _joined(row["word_answers"], "counts", np.uint32).astype(np.int64)
            single = totals.unigram(counts[right[own]])
            counts[text.words == START] = totals.texts
            mass = np.bincount(left[own], weights=totals.seen(seen[own]), minlength=len(text.words))
            share = np.bincount(left[own], weights=single, minlength=len(text.words))
            yield _questions(row["block"], text.words, parts, mass=mass, share=share, counts=counts)

    return ask


def _answer_contexts(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("block")  # sums of floats do not depend on the order of arrival
    keys = [_keys(k) for k in group["keys"]]
    cuts = np.cumsum([0, *map(len, keys)])
    held, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = lambda field: np.bincount(place, np.concatenate([unpack(c, np.float64) for c in group[field]]), len(held))
    count = np.zeros(len(held), np.int64)
    count[place] = np.concatenate([unpack(c, np.int64) for c in group["counts"]])
    divisor, weight = backoff(count, total("mass"), total("share"))
    weight, more = weight[place], (divisor > count)[place]
    each = range(len(keys))
    return pd.DataFrame(
        {
            "part": group["part"], "block": group["block"], "weight": [pack(weight[cuts[i] : cuts[i + 1]]) for i in each],
            "more": [pack(more[cuts[i] : cuts[i + 1]]) for i in each],
        }
    )


def backoff(count: np.ndarray, mass: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts seen ``count`` times with discounted counts ``mass`` for followers of single-word probability ``share``: the
    divisor of discounted counts, and the weight of the single-word probability of other followers."""
    free = count - mass
    divisor = np.where(count > 0, count + (free < 1e-9 * count), 1).astype(np.float64)
    weight = np.where(count > 0, (1 - mass / divisor) / np.maximum(1 - share, 1e-300), 1.0)
    return divisor, weight


def _scorer(totals: Totals):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _score_block(totals, row)

    return score


def _score_block(totals: Totals, row: dict) -> pa.RecordBatch:
    text = _Text.of(row)
    _, left, right, place = text.pairs()
    counts = _joined(row["word_answers"], "counts", np.uint32).astype(np.int64)
    seen = _joined(row["pair_answers"], "counts", np.uint32)
    weight, more = _joined(row["weights"], "weight", np.float64), _joined(row["weights"], "more", bool)
    divisor = np.where(text.words == START, totals.texts, counts) + more
    single = totals.unigram(counts) if totals.tokens else np.ones(len(counts))
    both = np.where(seen > 0, totals.seen(seen) / divisor[left], weight[left] * single[right])
    logs, base = np.log10(both), np.log10(single)
    starts = np.cumsum(text.lengths) - text.lengths
    total = lambda per_token: np.add.reduceat(per_token, starts)
    tokens, n = text.tokens, len(text.lengths)
    columns = [
        pa.array(row["doc_ids"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(text.lengths),
        pa.array(total((counts > 0)[tokens].astype(np.int64))), pa.array(np.full(n, totals.tokens, np.int64)),
        pa.array(total(base[tokens])), pa.array(total(logs[place])),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SCORES.split(", ")])
