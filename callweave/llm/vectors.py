"""Near duplicates of vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots), seen from the mean of all vectors: many encoders give
vectors with a large common part, which says nothing about any of them. The inverted lists hold, for each pivot, the
vectors that have it among their nearest, and a pair is compared in the list of the first pivot it shares. How many
pivots there are follows from the number of vectors, so that lists stay of one length, and how many describe a vector is
measured on a sample: enough for partners at the threshold to share one.

Lists carry vectors rounded to 16 bits a component, with the length of what rounding took off. That tells for nearly every
pair on which side of the threshold it lies; the others are settled by the vectors as given. A long list is cut into
blocks, and every two blocks are compared by a task of their own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.components import connected_components
from callweave.llm.support import save
from callweave.session import ship_package

CANDIDATES = 4096  # vectors, about, drawn by hash that pivots are chosen from: the bounded sample that the index is fitted on
MOST_PIVOTS = CANDIDATES // 2
ROWS_A_PIVOT = 128  # vectors of one label, about, for each pivot, until there are MOST_PIVOTS
LEAST_PIVOTS = 48
TRIED, RECALL, MOST_NEAREST = 1000, 0.99, 24  # sampled vectors given a partner; partners that must be found; pivots of a vector
APART = 0.8  # the cosine of two pivots is below this, so that one group of near vectors has one pivot, whatever its size
COSINE = 0.93
BLOCK = 1024  # vectors of one list in a block; two blocks are compared at a time
PART = 20_000  # entries of lists, about, that a task's group holds: many short lists, or a few blocks; each entry as often as it is dealt
PART_BYTES = 32 << 20  # bytes of vectors, about, that a task's group holds
LEVELS = 32767  # steps of a rounded component on either side of zero


class Index(NamedTuple):
    """For vectors of one length: their mean, the pivots as seen from it, and how many pivots describe a vector."""

    mean: np.ndarray
    pivots: np.ndarray
    nearest: int


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each row of ``table`` (``vec_id, embedding, label``).

    Vectors are compared when their labels are equal and not null and their lengths are equal. They are linked when they
    share one of their nearest pivots and their cosine, in double precision, is at least ``cosine``. ``n_links`` counts the
    other rows linked directly, repeated rows and repeated ids included; ``component_id`` is the least ``vec_id`` reachable (a null
    id is passed over unless there is no other), ``kept`` whether it is the row's own. A null, empty or zero vector and one
    with a null or non-finite component has no link. An empty table gives an empty result; other columns are ignored.
    """
    spark = table.sparkSession
    ship_package(spark)
    # numbered once and written, so that the numbers hold wherever the rows are read again
    rows = save(table.select("vec_id", "label", "embedding").withColumn("row", F.monotonically_increasing_id()), "vectors")
    usable = rows.where("label is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))")
    usable = usable.where("exists(embedding, x -> x != 0)")
    index = spark.sparkContext.broadcast(fit_index(usable, cosine))
    listed = usable.mapInArrow(_lister(index), _LISTED)
    lists = listed.groupBy("label", "width", "pivot").agg(F.count(F.lit(1)).alias("n"))
    lists = save(lists.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "lists")
    long_lists = lists.where("blocks > 1").drop("n")
    placed = listed.join(long_lists, ["label", "width", "pivot"], "left")
    block = F.pmod(F.xxhash64("row"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = placed.withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = placed.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    # every entry goes to each block of its list once
    size = F.col("width") * np.dtype(np.int16).itemsize
    entries, filled = lists.agg(F.sum(F.col("n") * F.col("blocks")), F.sum(F.col("n") * F.col("blocks") * size)).first()
    parts = max(1, (entries or 0) // PART, (filled or 0) // PART_BYTES)
    part = F.pmod(F.xxhash64("label", "width", "pivot", "low", "high"), F.lit(parts))
    found = dealt.groupBy(part.alias("part")).applyInPandas(_comparer(cosine), "row long, n long, root long, unsure boolean")
    found = save(found, "links")
    links = found.where("not unsure").drop("unsure").unionByName(_settled(found.where("unsure"), usable, cosine))
    counts = links.groupBy("row").agg(F.sum("n").alias("n_links"))
    labels = connected_components(links.select(F.col("row").alias("a"), F.col("root").alias("b")))
    known = rows.drop("embedding", "label").join(counts, "row", "left").join(labels.withColumnRenamed("node", "row"), "row", "left")
    known = known.withColumn("component", F.coalesce("component", "row"))
    roots = known.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return known.join(roots, "component").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _settled(unsure: DataFrame, usable: DataFrame, cosine: float) -> DataFrame:
    """Links of the pairs (``row, root``) that rounded vectors cannot tell, by the vectors as given; a row for each end."""
    vector = lambda name, of: usable.select(F.col("row").alias(name), F.col("embedding").alias(of))

    @F.pandas_udf("double")
    def exact(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(_unit(np.asarray(x, np.float64)) @ _unit(np.asarray(y, np.float64))) for x, y in zip(a, b)], dtype=np.float64)

    pairs = unsure.select("row", "root").join(vector("row", "a"), "row").join(vector("root", "b"), "root")
    linked = save(pairs.where(exact("a", "b") >= cosine).select("row", "root"), "settled")
    one = F.lit(1).cast("bigint").alias("n")
    return linked.select("row", one, "root").unionByName(linked.select(F.col("root").alias("row"), one, F.col("row").alias("root")))


_LISTED = "row long, label string, width int, pivot int, near binary, code binary, scale double, slack double"


def _unit(vector: np.ndarray) -> np.ndarray:
    vector = vector / np.abs(vector).max(axis=-1, keepdims=True)  # else squares of very large or small numbers are lost
    return vector / np.linalg.norm(vector, axis=-1, keepdims=True)


# --- the index -------------------------------------------------------------------------------------------------


def fit_index(usable: DataFrame, cosine: float) -> dict[int, Index]:
    """An index for each length of vectors in a sample of about ``CANDIDATES`` rows. A length that is not in it has one list."""
    groups = usable.groupBy("label", F.size("embedding").alias("width")).count()
    total, squares = groups.agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    if not total:
        return {}
    drawn = F.pmod(F.xxhash64("row"), F.lit(total)) < CANDIDATES
    sample = usable.where(drawn).orderBy(F.xxhash64("row"), "row").limit(2 * CANDIDATES).select("embedding").collect()
    by_width: dict[int, list[np.ndarray]] = {}
    for (vector,) in sample:
        by_width.setdefault(len(vector), []).append(np.asarray(vector, dtype=np.float64))
    # the size of the label that a vector lies in, on average
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, squares / total // ROWS_A_PIVOT)))
    return {width: index_of(_unit(np.stack(vectors)), wanted, cosine) for width, vectors in by_width.items()}


def index_of(sample: np.ndarray, wanted: int, cosine: float) -> Index:
    """The index of unit vectors: up to ``wanted`` pivots, and as many nearest ones as a partner needs to be found."""
    mean = sample.mean(axis=0) if len(sample) >= LEAST_PIVOTS else np.zeros(sample.shape[1])
    common = float(mean @ mean)  # the mean cosine of two vectors
    seen = _seen_from(sample, mean)
    # partners at the threshold have this cosine as seen from the mean; members of a group of partners, thus, are no pivots of their own
    partner = (cosine - common) / max(1 - common, 1e-9)
    pivots = choose_pivots(seen, wanted, min(APART, max(0.3, partner - 0.1)))
    index = Index(mean, pivots, len(pivots))
    for nearest in range(1, min(MOST_NEAREST, len(pivots)) + 1):
        if recall_on(sample, index._replace(nearest=nearest), cosine) >= RECALL:
            return index._replace(nearest=nearest)
    return index._replace(nearest=min(MOST_NEAREST, len(pivots)))


def recall_on(sample: np.ndarray, index: Index, cosine: float) -> float:
    """The share of partners at exactly ``cosine`` that share a pivot with the sampled vector they are made of: the smaller of those that
    differ in any direction and those that differ as the vectors of the sample do."""
    tried = sample[:TRIED]
    draw = np.random.Generator(np.random.PCG64(17))
    anywhere = draw.normal(size=tried.shape)
    alike = sample[draw.integers(len(sample), size=len(tried))] - sample[draw.integers(len(sample), size=len(tried))]
    found, own = [], np.sort(nearest_pivots(tried, index), axis=1)
    for away in (anywhere, alike):
        away = away - (away * tried).sum(axis=1, keepdims=True) * tried
        length = np.linalg.norm(away, axis=1, keepdims=True)
        some = length[:, 0] > 1e-9
        if some.any():
            partners = cosine * tried[some] + np.sqrt(1 - cosine * cosine) * away[some] / length[some]
            theirs = np.sort(nearest_pivots(partners, index), axis=1)
            found.append(float((first_shared(own[some], theirs) >= 0).mean()))
    return min(found, default=1.0)


def _seen_from(unit: np.ndarray, mean: np.ndarray) -> np.ndarray:
    away = unit - mean
    return away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)


def choose_pivots(candidates: np.ndarray, wanted: int, apart: float = APART) -> np.ndarray:
    """The first ``wanted`` of ``candidates`` that lie apart from those before them. Pivots inside a group of near vectors would take all
    places among the nearest of its members, and noise would say which."""
    chosen, n = np.zeros((wanted, candidates.shape[1])), 0
    for vector in candidates:
        if not n or (chosen[:n] @ vector).max() < apart:
            chosen[n] = vector
            n += 1
            if n == wanted:
                break
    return chosen[:n]


def nearest_pivots(unit: np.ndarray, index: Index) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first."""
    likeness = _seen_from(unit, index.mean) @ index.pivots.T
    return np.argsort(-likeness, axis=1, kind="stable")[:, : index.nearest]


def first_shared(near: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least number that the sorted rows of ``near`` and ``other`` share, -1 if none."""
    least = np.full(len(near), np.iinfo(np.int64).max)
    for one in near.T:
        for two in other.T:
            least = np.where(one == two, np.minimum(least, one), least)
    return np.where(least == np.iinfo(np.int64).max, -1, least)


def _lister(shared):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, Index] = shared.value
        for batch in itertools.chain.from_iterable((b.slice(k, 1000) for k in range(0, b.num_rows, 1000)) for b in batches):
            vectors = batch.column("embedding").to_pylist()
            widths = np.array([len(v) for v in vectors])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                unit = _unit(np.array([vectors[k] for k in at], dtype=np.float64))
                index = indexes.get(int(width))
                near = np.sort(nearest_pivots(unit, index), axis=1).astype(np.int16) if index else np.zeros((len(at), 1), np.int16)
                scale = np.abs(unit).max(axis=1) / LEVELS
                code = np.rint(unit / scale[:, None]).astype(np.int16)
                slack = np.linalg.norm(unit - code * scale[:, None], axis=1) + 1e-12
                times = near.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(batch.column("row").to_numpy()[at], times)),
                        pa.concat_arrays([batch.column("label").cast(pa.string()).take(pa.array(at))] * times),
                        pa.array(np.full(len(at) * times, width, np.int32)),
                        pa.array(near.T.ravel().astype(np.int32)),
                        pa.array([n.tobytes() for n in near] * times, pa.binary()),
                        pa.array([c.tobytes() for c in code] * times, pa.binary()),
                        pa.array(np.tile(scale, times)),
                        pa.array(np.tile(slack, times)),
                    ],
                    names=["row", "label", "width", "pivot", "near", "code", "scale", "slack"],
                )

    return emit


# --- lists -----------------------------------------------------------------------------------------------------


def _comparer(cosine: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        label = pd.factorize(group["label"])[0]
        columns = [group[c].to_numpy() for c in ("high", "low", "pivot", "width")]
        order = np.lexsort([group["block"].to_numpy(), *columns, label])
        group = group.iloc[order]
        keys = np.stack([*(c[order] for c in columns), label[order]])
        ends = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(group)]))
        rows, block, scale, slack = (group[c].to_numpy() for c in ("row", "block", "scale", "slack"))
        code, near = group["code"].to_numpy(), group["near"].to_numpy()
        out = [np.zeros((4, 0), np.int64)]
        for a, b in itertools.pairwise(ends):
            if b - a > 1:
                high, low, pivot, width = keys[:4, a]
                rounded = np.frombuffer(b"".join(code[a:b]), np.int16).reshape(-1, width) * scale[a:b, None]
                pivots = np.frombuffer(b"".join(near[a:b]), np.int16).reshape(b - a, -1)
                split = int(np.searchsorted(block[a:b], high)) if low != high else None
                counts, root, unsure = _links(rounded, slack[a:b], pivots, pivot, split, cosine)
                held = counts > 0
                own = rows[a:b]
                out.append(np.stack([own[held], counts[held], own[root[held]], np.zeros(held.sum(), np.int64)]))
                out.append(np.stack([own[unsure[0]], np.zeros(len(unsure[0]), np.int64), own[unsure[1]], np.ones(len(unsure[0]), np.int64)]))
        found = np.concatenate(out, axis=1)
        return pd.DataFrame({"row": found[0], "n": found[1], "root": found[2], "unsure": found[3].astype(bool)})

    return compare


def _links(
    rounded: np.ndarray, slack: np.ndarray, near: np.ndarray, pivot: int, split: int | None, cosine: float
) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of one list: how many others each is surely linked with, the first of those connected with it, and the pairs that
    rounding leaves open. With ``split``, only the vectors before it are compared with those after it. Pairs that meet in
    an earlier list are left to that one."""
    n = len(rounded)
    first, second = (np.arange(n),) * 2 if split is None else (np.arange(split), np.arange(split, n))
    counts, root, open_i, open_j = np.zeros(n, np.int64), np.arange(n), [], []
    for k in range(0, len(first), 256):
        part = first[k : k + 256]
        # rounding moves a product by no more than what it took off both vectors
        room = slack[part][:, None] + slack[second] + slack[part][:, None] * slack[second]
        value = rounded[part] @ rounded[second].T - cosine
        at, to = np.nonzero(value >= -room)
        sure = value[at, to] >= room[at, to]
        i, j = part[at], second[to]
        if split is None:
            ahead = i < j
            i, j, sure = i[ahead], j[ahead], sure[ahead]
        here = first_shared(near[i], near[j]) == pivot
        i, j, sure = i[here], j[here], sure[here]
        open_i.append(i[~sure])
        open_j.append(j[~sure])
        i, j = i[sure], j[sure]
        if not len(i):
            continue
        counts += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
        while True:  # the least number of each connected part
            least = np.minimum(root[i], root[j])
            if np.array_equal(root[i], least) and np.array_equal(root[j], least):
                break
            for old in (root[i], root[j]):
                np.minimum.at(root, old, least)
            root = root[root]
    while not np.array_equal(root, root[root]):
        root = root[root]
    none = [np.zeros(0, np.int64)]
    return counts, root, (np.concatenate(none + open_i), np.concatenate(none + open_j))
