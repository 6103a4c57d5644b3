"""Cosine matches between sentences and topics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.constants import COSINE_THRESHOLD, MAX_BROADCAST_BYTES, TERM_SALTS
from callweave.functions.text import squared_norm, term_counts, terms
from callweave.operators.term_index import MATCH_TYPE, TermIndex
from callweave.operators.tiles import match_in_tiles
from callweave.session import materialise, number_rows, ship_package
from callweave.sources.catalogue import Catalogue


def term_vectors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, squared_norm, term, tf``: the term counts of each text, long form. Counted within the row."""
    counted = texts.select(*keys, term_counts(terms(F.col(text))).alias("counts"))
    normed = counted.withColumn("squared_norm", squared_norm(F.col("counts")))
    # For an inner inline the optimizer adds a filter on empty lists, and with it a second count of every text.
    return normed.select(*keys, "squared_norm", F.inline_outer("counts")).where(F.col("term").isNotNull())


def lexical_matches(
    sentences: DataFrame,
    catalogue: Catalogue,
    keys: tuple[str, str] = ("conv_id", "position"),
    text: str = "sentence",
    threshold: tuple[int, int] = COSINE_THRESHOLD,
    spread: bool = True,
) -> DataFrame:
    """Pairs of sentence and topic whose term-count cosine is above ``threshold``.

    Adds ``topic_no, dot, sentence_sq, topic_sq, cos_sim`` to the rows of ``sentences``. Counts are integers and the
    threshold a fraction, so the test is exact. The catalogue is measured first. Within the bound it is broadcast as an
    inverted index and each sentence is matched where it is; beyond it, both sides are matched in tiles.

    ``spread`` moves sentences by their full key first: sentences come out of calls, and a very long call would leave
    all of its own to one task. Switch it off when the texts are known to be short; then nothing is shuffled.
    """
    ship_package(sentences.sparkSession)
    if spread:
        sentences = sentences.repartition(*keys)
    postings = term_vectors(catalogue.topics, ["topic_no"], "description").select(
        "topic_no", "term", F.col("tf").alias("topic_tf"), F.col("squared_norm").alias("topic_sq")
    )
    if catalogue.is_small:
        found = _matches_by_index(sentences, postings, text, threshold)
    else:
        numbered = number_rows(sentences, SENTENCE_NO)
        matched = _matches_in_tiles(lexical_tiles(numbered, postings, catalogue.blocks, text, threshold), threshold)
        found = numbered.join(matched, SENTENCE_NO).drop(SENTENCE_NO)
    scale = F.sqrt((F.col("sentence_sq") * F.col("topic_sq")).cast("double"))
    return found.withColumn("cos_sim", F.round(F.col("dot") / scale, 6))


def _matches_by_index(
    sentences: DataFrame, postings: DataFrame, text: str, threshold: tuple[int, int]
) -> DataFrame:
    index = sentences.sparkSession.sparkContext.broadcast(TermIndex.build(postings.toPandas()))

    @F.arrow_udf(MATCH_TYPE)
    def match(term_lists: pa.Array) -> pa.Array:
        return index.value.matches(term_lists, threshold)

    # Declared nondeterministic, or the optimizer would first run it once more to filter out sentences without a match.
    matched = sentences.withColumn("matched", match.asNondeterministic()(terms(F.col(text))))
    return matched.select(*sentences.columns, F.inline("matched"))


SENTENCE_NO = "sentence_no"


@dataclass(frozen=True)
class LexicalTiles:
    """``rows`` (``row_no, block, terms``), the sentences with the blocks they may have a partner in, and ``postings`` by block."""

    rows: DataFrame
    postings: DataFrame
    total_rows: int


def lexical_tiles(numbered: DataFrame, postings: DataFrame, blocks: int, text: str, threshold: tuple[int, int]) -> LexicalTiles:
    """Deal sentences to the blocks of topics that they may match, by the prefixes of both.

    Terms are ordered by the number of topics that hold them. From a sentence's commonest terms on, terms are passed over as
    long as those alone cannot reach the threshold with any topic: by Cauchy's inequality, or by the greatest weight each of
    them has in any topic. The rest is the prefix; topics have one by Cauchy's inequality. A pair above the threshold
    shares a term, and the rarest it shares is in both prefixes. So a sentence goes to those blocks only that hold one of
    its prefix terms in a topic's prefix. Counts are integers; where weights are compared, some slack keeps a sentence in.

    A term of a sentence meets one row of the catalogue, not one for each topic, and each term is dealt to ``TERM_SALTS`` groups.
    """
    p, q = threshold
    frequent = postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.max(F.col("topic_tf") / F.sqrt(F.col("topic_sq").cast("double"))).alias("most")
    )
    block = F.pmod(F.xxhash64("topic_no"), F.lit(blocks)).cast("int")
    postings = materialise(postings.join(frequent, "term").withColumn("block", block), "postings")
    commonest_first = Window.partitionBy("topic_no").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum(F.col("topic_tf") * F.col("topic_tf")).over(commonest_first)
    in_prefix = F.lit(q * q) * passed > F.lit(p * p) * F.col("topic_sq")
    held = F.collect_set(F.when(F.col("in_prefix"), F.col("block"))).alias("blocks")
    looked_up = postings.withColumn("in_prefix", in_prefix).groupBy("term", "df", "most").agg(held)

    counted = term_vectors(numbered, [SENTENCE_NO], text)
    salted = counted.withColumn("salt", F.pmod(F.col(SENTENCE_NO), F.lit(TERM_SALTS)).cast("int"))
    copies = looked_up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    met = salted.join(copies.hint("shuffle_hash"), ["term", "salt"])
    entry = F.struct((-F.col("df")).alias("order"), "term", "tf", "most", "blocks")
    lists = met.groupBy(SENTENCE_NO).agg(F.max("squared_norm").alias("sq"), F.sort_array(F.collect_list(entry)).alias("entries"))
    dealt = lists.select(SENTENCE_NO, F.explode(_prefix_blocks(threshold)).alias("block"))
    rows = numbered.select(SENTENCE_NO, terms(F.col(text)).alias("terms")).join(dealt, SENTENCE_NO)
    total = numbered.count()
    return LexicalTiles(rows.select(F.col(SENTENCE_NO).alias("row_no"), "block", "terms"), postings.drop("df", "most"), total)


def _prefix_blocks(threshold: tuple[int, int]) -> Column:
    """Blocks of the prefix of ``entries``, which are ordered by falling frequency, for a squared norm ``sq``."""
    p, q = threshold
    square = F.col("sq")

    def step(state: Column, entry: Column) -> Column:
        squares = state["squares"] + entry["tf"] * entry["tf"]
        weights = state["weights"] + entry["tf"] * entry["most"]
        small = F.lit(q * q) * squares <= F.lit(p * p) * square
        weak = F.lit(q * q) * weights * weights < F.lit(p * p * (1 - 1e-9)) * square
        blocks = F.when(small | weak, state["blocks"]).otherwise(F.array_union(state["blocks"], entry["blocks"]))
        return F.struct(squares.alias("squares"), weights.alias("weights"), blocks.alias("blocks"))

    start = F.struct(
        F.lit(0).cast("bigint").alias("squares"), F.lit(0.0).alias("weights"), F.array().cast("array<int>").alias("blocks")
    )
    return F.aggregate("entries", start, step, lambda state: state["blocks"])


def _matches_in_tiles(tiles: LexicalTiles, threshold: tuple[int, int]) -> DataFrame:
    columns = (SENTENCE_NO, "topic_no", "dot", "sentence_sq", "topic_sq")

    def match(rows: pa.Table, postings: pa.Table) -> pa.Table:
        if not rows.num_rows or not postings.num_rows:
            return pa.table({name: pa.array([], pa.int64()) for name in columns})
        index = TermIndex.build(postings.select(["topic_no", "term", "topic_tf", "topic_sq"]).to_pandas())
        found = index.matches(rows["terms"].combine_chunks(), threshold)
        owner = rows["row_no"].combine_chunks().take(pc.list_parent_indices(found))
        return pa.table([owner, *pc.list_flatten(found).flatten()], names=list(columns))

    schema = ", ".join(f"{name} bigint" for name in columns)
    return match_in_tiles(tiles.rows, tiles.postings, tiles.total_rows, match, schema)


def label_centroids(embeddings: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """``topic_no, vector``: the mean vector of each label. Sums of whole vectors are formed before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    doubles = array_to_vector(F.col(vector).cast("array<double>"))
    given = embeddings.where(F.col(vector).isNotNull()).groupBy(F.col(label).cast("bigint").alias("topic_no"))
    return given.agg(vector_to_array(Summarizer.mean(doubles)).alias("vector"))


TILE_CELLS = 1 << 21  # products held at a time
TILE_SIDE = 1 << 12  # vectors, and topics, that meet in a tile on average; a larger block is a shelf of its own
LEAST_SHELVES = 8  # and slices of vectors, so that small tables are spread too
PIVOTS = 16  # topics whose angles to all others are known
RING = 0.1  # width in radians of the rings of topics around a pivot
RINGS = math.ceil(math.pi / RING)
ANGLE_SLACK = 1e-6  # an angle's rounding may not cost a match


def dense_matches(
    vectors: DataFrame,
    topics: DataFrame,
    threshold: float,
    vector: str = "vector",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Pairs of rows of ``vectors`` and ``topics`` with cosine above ``threshold``.

    Adds ``topic_no, cos_sim`` to the columns of ``vectors`` without ``vector``. ``topics`` is measured first. A matrix within the
    bound goes to the executors and each Arrow batch is multiplied by it; nothing is shuffled and only matches leave the
    task. Beyond the bound, both sides are matched in tiles of ``block_bytes`` of topics, see ``dense_tiles``.
    """
    ship_package(vectors.sparkSession)
    topics = materialise(topics, "topics")  # measured and read below; an encoder runs over them once
    count, width = topics.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if (count or 0) * (width or 0) * 8 <= max_broadcast_bytes:
        return _dense_block(vectors, topics, threshold, vector)
    numbered = number_rows(vectors, SENTENCE_NO)
    topics_in_block = max(1, block_bytes // (8 * width))
    matched = _dense_in_tiles(dense_tiles(numbered, topics, threshold, vector, topics_in_block), threshold, vector, topics_in_block)
    return numbered.drop(vector).join(matched, SENTENCE_NO).drop(SENTENCE_NO).withColumn("cos_sim", F.round("cos_sim", 6))


@dataclass(frozen=True)
class Rings:
    """Rings of topics by number: the least and greatest angle of each to every pivot, and its blocks."""

    pivots: np.ndarray
    numbers: np.ndarray
    seen: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    reach: float

    def near(self, units: np.ndarray, rings: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Whether a ring may hold a partner: a row for each vector, a column for each of ``rings``, places in ``numbers``."""
        angles = np.arccos(np.clip(units @ self.pivots.T, -1, 1))
        seen = self.seen[rings]
        near = np.ones((len(angles), len(seen)), bool)
        for k in range(angles.shape[1]):
            own = angles[:, k, None]
            near &= (own - self.reach <= seen[:, 1, k]) & (own + self.reach >= seen[:, 0, k])
        return near

    def on_shelves(self, blocks_on_shelf: int) -> np.ndarray:
        """Whether a ring, a row, has topics on a shelf, a column. Blocks are numbered ring by ring."""
        ends = (self.first + self.sizes - 1) // blocks_on_shelf
        shelves = np.arange(ends.max(initial=-1) + 1)
        return (shelves >= (self.first // blocks_on_shelf)[:, None]) & (shelves <= ends[:, None])


@dataclass(frozen=True)
class DenseTiles:
    """``rows`` (``row_no, block, vector``), the vectors with the blocks they may have a partner in; ``topics`` with their ``ring`` and
    ``block``; the number of vectors and of blocks. Without pruning, ``rows`` would have the product of the two. ``on_shelves`` gives
    vectors and topics (``row_no`` or ``topic_no, ring``, ``block, vector``) by shelves of several blocks instead."""

    rows: DataFrame
    topics: DataFrame
    total_rows: int
    blocks: int
    rings: Broadcast | None = None
    on_shelves: Callable[[int], tuple[DataFrame, DataFrame]] | None = None


def dense_tiles(numbered: DataFrame, topics: DataFrame, threshold: float, vector: str, topics_in_block: int) -> DenseTiles:
    """Deal vectors to the blocks of topics that they may match.

    ``PIVOTS`` topics are drawn by a hash of their numbers. Every topic lies in a ring around its nearest pivot, and a ring is cut into
    blocks of about ``topics_in_block``. Of each ring the least and greatest angle to every pivot is known. Angles obey the triangle
    inequality, so a topic within the threshold's angle of a vector is, seen from any pivot, no further from it than that:
    a ring whose range lies further off for one pivot is left out, and none of its products is formed. What reaches the
    driver is the pivots and the ranges of ``PIVOTS * RINGS`` rings, whatever the input. Null and zero vectors, and those with
    a component that is no finite number, match nothing and are not dealt.
    """
    spark = numbered.sparkSession
    drawn = topics.where(_is_direction(vector)).orderBy(F.xxhash64("topic_no"), "topic_no").limit(PIVOTS).select(vector).toPandas()
    if drawn.empty:
        rows = numbered.select(F.col(SENTENCE_NO).alias("row_no"), F.lit(0).alias("block"), vector).where(F.lit(False))
        return DenseTiles(rows, topics.select("topic_no", vector, F.lit(0).alias("block")).where(F.lit(False)), 0, 0)
    pivots = spark.sparkContext.broadcast(_unit(drawn[vector]))

    @F.arrow_udf("array<double>")
    def angles_of(batch: pa.Array) -> pa.Array:
        angles = _angles(batch, pivots.value)
        offsets = np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(angles.ravel()))

    placed = topics.where(_is_direction(vector)).withColumn("angles", angles_of.asNondeterministic()(vector))
    nearest = F.array_min("angles")
    ring = F.array_position("angles", nearest) * RINGS + F.least(F.floor(nearest / RING), F.lit(RINGS - 1))
    placed = materialise(placed.select("topic_no", vector, "angles", ring.cast("int").alias("ring")), "placed")
    bounds = [f(F.col("angles")[k]) for f in (F.min, F.max) for k in range(len(drawn))]
    ranges = placed.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.array(*bounds).alias("bounds")).orderBy("ring").collect()
    sizes = {r["ring"]: -(-r["n"] // topics_in_block) for r in ranges}
    starts, blocks = {}, 0
    for number, n in sizes.items():
        starts[number], blocks = blocks, blocks + n
    reach = math.acos(min(1.0, max(-1.0, threshold))) + ANGLE_SLACK
    seen = np.array([r["bounds"] for r in ranges]).reshape(len(sizes), 2, -1)
    of_rings = (np.array(list(x), np.int32) for x in (sizes, starts.values(), sizes.values()))
    numbers, first, counts = of_rings
    rings = spark.sparkContext.broadcast(Rings(pivots.value, numbers, seen, first, counts, reach))

    def in_reach(blocks_on_shelf: int | None) -> Column:
        """Numbers of the rings, or of the shelves, that may hold a partner."""

        @F.arrow_udf("array<int>")
        def found(batch: pa.Array) -> pa.Array:
            near, names = rings.value.near(_unit_rows(_matrix(batch))) if len(batch) else np.zeros((0, 0), bool), rings.value.numbers
            if blocks_on_shelf and len(batch):
                near = near.astype(np.float32) @ rings.value.on_shelves(blocks_on_shelf).astype(np.float32) > 0
                names = np.arange(near.shape[1])
            row, at = np.nonzero(near)
            offsets = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names[at], pa.int32()))

        return found.asNondeterministic()(vector)

    start, size = (F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) for d in (starts, sizes))
    part = F.pmod(F.xxhash64("topic_no"), F.element_at(size, F.col("ring"))).cast("int")
    dealt_topics = placed.select("topic_no", vector, "ring", (F.element_at(start, F.col("ring")) + part).alias("block"))

    directions = numbered.where(_is_direction(vector))
    known = directions.withColumn("ring", F.explode(in_reach(None))).withColumn("first", F.element_at(start, F.col("ring")))
    every = F.sequence(F.col("first"), F.col("first") + F.element_at(size, F.col("ring")) - 1)
    rows = known.select(F.col(SENTENCE_NO).alias("row_no"), F.explode(every).alias("block"), vector)

    def on_shelves(blocks_on_shelf: int) -> tuple[DataFrame, DataFrame]:
        dealt = directions.select(F.col(SENTENCE_NO).alias("row_no"), F.explode(in_reach(blocks_on_shelf)).alias("block"), vector)
        return dealt, dealt_topics.withColumn("block", F.floor(F.col("block") / blocks_on_shelf).cast("int"))

    return DenseTiles(rows, dealt_topics, numbered.count(), blocks, rings, on_shelves)


def _is_direction(vector: str) -> Column:
    numbers = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & numbers & F.exists(vector, lambda x: x != 0)


def _angles(batch: pa.Array, pivots: np.ndarray) -> np.ndarray:
    if not len(batch):
        return np.zeros((0, len(pivots)))
    return np.arccos(np.clip(_unit_rows(_matrix(batch)) @ pivots.T, -1, 1))


def _dense_in_tiles(tiles: DenseTiles, threshold: float, vector: str, topics_in_block: int) -> DataFrame:
    """A vector crosses the shuffle once for a shelf of blocks, not for each of its blocks, and a topic once for a slice of vectors. Tiles
    are about as wide as high, at which the copies of both sides are fewest. In a tile only those rings are multiplied that a vector reaches.
    """
    known = tiles.rings

    def match(rows: pa.Table, topics: pa.Table) -> pa.Table:
        number, topic_no, cosines = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if rows.num_rows and topics.num_rows:
            topics = topics.sort_by("ring")
            targets = _unit_rows(_matrix(topics[vector].combine_chunks()))
            present, first_of, sizes = np.unique(topics["ring"].to_numpy(), return_index=True, return_counts=True)
            places = np.searchsorted(known.value.numbers, present)
            numbers, of_topics = rows["row_no"].to_numpy(), topics["topic_no"].to_numpy()
            step = max(1, TILE_CELLS // len(targets))
            for first in range(0, rows.num_rows, step):
                units = _unit_rows(_matrix(rows[vector].slice(first, step).combine_chunks()))
                for near, start, size in zip(known.value.near(units, places).T, first_of, sizes):
                    reached = np.flatnonzero(near)
                    if not len(reached):
                        continue
                    cosine = units[reached] @ targets[start : start + size].T
                    row, col = np.nonzero(cosine > threshold)
                    number.append(numbers[first + reached[row]])
                    topic_no.append(of_topics[start + col])
                    cosines.append(cosine[row, col])
        found = (np.concatenate(parts) for parts in (number, topic_no, cosines))
        return pa.table([pa.array(part) for part in found], names=[SENTENCE_NO, "topic_no", "cos_sim"])

    schema = f"{SENTENCE_NO} bigint, topic_no bigint, cos_sim double"
    if tiles.on_shelves is None:
        return match_in_tiles(tiles.rows, tiles.topics, tiles.total_rows, match, schema)
    blocks_on_shelf = max(1, min(TILE_SIDE // topics_in_block, -(-tiles.blocks // LEAST_SHELVES)))
    tile_rows = max(1, min(TILE_SIDE, -(-tiles.total_rows // LEAST_SHELVES)))
    return match_in_tiles(*tiles.on_shelves(blocks_on_shelf), tiles.total_rows, match, schema, tile_rows)


def _dense_block(vectors: DataFrame, topics: DataFrame, threshold: float, vector: str) -> DataFrame:
    rows = topics.select("topic_no", vector).orderBy("topic_no").toPandas()
    numbers = rows["topic_no"].to_numpy(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((numbers, _unit(rows[vector])))
    kept = [field for field in vectors.schema.fields if field.name != vector]
    schema = T.StructType(
        [*kept, T.StructField("topic_no", T.LongType()), T.StructField("cos_sim", T.DoubleType())]
    )
    names = [field.name for field in kept]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        topic_no, matrix = shared.value
        for batch in batches:
            batch = batch[batch[vector].notna()]
            if batch.empty or not len(topic_no):
                continue
            # tiles of rows: the products of a tile and all topics of the block take a fixed amount of memory
            rows = max(1, TILE_CELLS // len(topic_no))
            for first in range(0, len(batch), rows):
                tile = batch.iloc[first : first + rows]
                cosine = _unit(tile[vector]) @ matrix.T
                row, col = np.nonzero(cosine > threshold)
                yield tile[names].iloc[row].assign(topic_no=topic_no[col], cos_sim=cosine[row, col])

    return vectors.mapInPandas(match, schema).withColumn("cos_sim", F.round("cos_sim", 6))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors of length one as rows. A zero vector gives NaN, which is above no threshold, hence no match."""
    return _unit_rows(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0)))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length, without nulls, as rows."""
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
