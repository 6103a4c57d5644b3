"""Near duplicates of texts by HyperMinHash.

A document is the set of its shingles. Documents with equal sets form a class; everything after that is done once a class.
The sketch of a class has a register for each bucket of hash values: the number of leading zeros of the least hash in the
bucket and the ten bits that follow, in 16 bits. Registers an empty bucket lacks are borrowed, each by an order of its own.
Bands of registers make candidates, the estimated similarity (corrected for registers that agree by chance) discards most
false ones, and the full sets of the others are compared.

Members of one bucket are never paired with each other at first, only with one leader, another one in each band. After
these links are confirmed, pairs inside a bucket remain only between members that are not yet connected, and those are
compared block by block inside tasks, never as rows.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.components import connected_components
from callweave.llm.hashing import shingles, word_hashes
from callweave.llm.support import save
from callweave.session import ship_package

BUCKET_BITS, MANTISSA_BITS = 7, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, BAND = 25, 5  # of a pair with similarity 0.8 all bands differ with probability (1 - 0.8 ** 5) ** 25, 5 in 100,000
PART = 5_000  # rows, about, that a task's group of small buckets holds
PART_BYTES = 16 << 20  # bytes of sets, about, in a task's group of small buckets
BLOCK = 2048  # members of a bucket in a block; two blocks of one bucket make a task's group
BLOCK_BYTES = 16 << 20  # bytes of sets, about, in a block
DEVIATIONS = 4.5  # the estimate discards a pair only if it lies so many standard deviations below the threshold
CHANCE = 0.169919487159739  # of the HyperMinHash paper: registers that agree by chance, times 2 ** (buckets' bits - mantissa's)

_PROBES = np.stack([np.random.Generator(np.random.PCG64(j)).permutation(BUCKETS) for j in range(BUCKETS)])


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, mark, n_shingles, class_id, component_id, kept``: one row for each row of ``docs`` (``doc_id, text``).

    Words are runs of other characters than ASCII blanks, A-Z lower-cased; a text with fewer words than ``shingle`` is one
    shingle. Two documents are linked when ``100 * intersection >= percent * union`` of their sets. ``component_id`` is the
    least ``doc_id`` reachable (a null id is passed over unless there is no other), ``kept`` whether it is the row's own,
    ``class_id`` is equal for equal sets, ``mark`` the text's hash. Null, empty and blank texts have no shingle and are linked
    with nothing. Repeated rows are equal sets. An empty table gives an empty result; other columns are ignored.

    All pairs that share a band are linked or refused by their full sets, or connected already; there is no cap.
    """
    ship_package(docs.sparkSession)
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    sketches = save(texts.mapInArrow(_sketcher(shingle), _SKETCH), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")
    classes = sketches.where("class_id is not null").groupBy("class_id").agg(
        F.min(place).alias("p"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")
    )
    classes = save(classes.select("class_id", "p.doc_id", "p.mark", "n", "registers"), "classes")
    size = 2 * BAND
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("registers", b * size + 1, F.lit(size)))
    )
    banded = classes.select("class_id", "n", F.explode(band).alias("band"))
    # a bucket's leader: the member whose id, scrambled by the bucket, is least
    leaders = banded.groupBy("band").agg(F.min(F.col("class_id").bitwiseXOR(F.col("band"))).alias("m"), F.count("*").alias("c"))
    leaders = leaders.where("c > 1").select("band", F.col("m").bitwiseXOR(F.col("band")).alias("leader"))
    members = save(banded.join(leaders, "band"), "members")
    stars = members.where("class_id != leader").select(F.least("class_id", "leader").alias("a"), F.greatest("class_id", "leader").alias("b"))
    stars = save(stars.distinct(), "stars")
    near = save(_likely(stars, classes, percent), "near")
    wanted = _texts(texts, classes, near)
    # first the likeliest link of each class; then what these have not connected
    ends = near.select("a", "b", "likeness", F.explode(F.array("a", "b")).alias("node"))
    best = ends.groupBy("node").agg(F.max(F.struct("likeness", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    best = save(best, "best")
    links = save(_confirmed(best, wanted, shingle, percent), "links")
    labels = connected_components(links)
    rest = _apart(near.join(best, ["a", "b"], "left_anti"), labels)
    more = save(_confirmed(rest, wanted, shingle, percent), "links")
    links = links.unionByName(more)
    labels = connected_components(links) if more.take(1) else labels
    late = save(_inside_buckets(members, labels, classes, texts, shingle, percent), "links")
    if late.take(1):
        labels = connected_components(links.unionByName(late))
    named = classes.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "class_id", "doc_id", F.coalesce("component", "class_id").alias("component")
    )
    roots = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = save(named.join(roots, "component").select("class_id", "component_id"), "named")
    linked = sketches.drop("registers").join(named, "class_id", "left")
    component = F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    linked = linked.withColumn("component_id", component)
    return linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        "doc_id", "mark", "n_shingles", "class_id", "component_id", "kept"
    )


_SKETCH = "doc_id long, mark long, n_shingles long, class_id long, registers binary"


def _sketcher(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column("text"))
            rows = batch.num_rows
            least, filled = np.zeros((rows, BUCKETS), np.uint64), np.zeros((rows, BUCKETS), bool)
            counts, ids = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            for r in range(rows):
                held = shingles(words[at[r] : at[r + 1]], size)
                counts[r] = len(held)
                if len(held):
                    ids[r] = int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8).digest(), "little", signed=True)
                    bucket = held >> np.uint64(64 - BUCKET_BITS)
                    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))  # sorted: the least of each bucket
                    least[r, bucket[first]] = held[first] << np.uint64(BUCKET_BITS)
                    filled[r, bucket[first]] = True
            empty = counts == 0
            packed = registers(least, filled)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), pa.array(counts), pa.array(ids, mask=empty),
                    pa.array([None if e else p.tobytes() for e, p in zip(empty, packed, strict=True)], pa.binary()),
                ],
                names=["doc_id", "mark", "n_shingles", "class_id", "registers"],
            )

    return sketch


def registers(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hash of each bucket; an empty bucket takes the first filled one in its order."""
    mantissa, exponent = np.frexp(least.astype(np.float64))
    zeros = np.minimum(64 - exponent, 63)
    zeros[least == 0] = 63
    fraction = np.clip((2 * mantissa - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1)
    out = (zeros << MANTISSA_BITS | fraction.astype(np.int64)).astype(np.uint16)
    row, bucket = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for k in range(0, len(row), 1 << 14):
        r, b = row[k : k + (1 << 14)], bucket[k : k + (1 << 14)]
        donor = _PROBES[b, np.argmax(filled[r[:, None], _PROBES[b]], axis=1)]
        out[r, b] = out[r, donor]
    return out


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, likeness`` of the pairs whose sizes and sketches allow a link."""
    side = lambda x: classes.select(F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    both = both.where(fits).select("a", "b", "na", "nb", "ra", "rb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
            chance = CHANCE * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * (na / nb) / (1 + na / nb) ** 2
            likeness = ((ra == rb).sum(axis=1) - chance) / BUCKETS
            share = percent / 100
            margin = DEVIATIONS * np.sqrt(share * (1 - share) / np.minimum(BUCKETS, np.maximum(na, nb)))
            keep = pa.array(likeness >= share - margin)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(likeness)], names=["a", "b", "likeness"])
            yield out.filter(keep)

    return both.mapInArrow(compare, "a long, b long, likeness double")


def _texts(texts: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``class_id, text`` of the classes that occur in pairs."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    rows = classes.join(nodes, "class_id", "left_semi").select("class_id", F.col("doc_id").alias("d"), F.col("mark").alias("m"))
    found = texts.join(rows, (F.col("mark") == F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return save(found.dropDuplicates(["class_id"]).select("class_id", "text"), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    side = lambda x: texts.select(F.col("class_id").alias(x), F.col("text").alias(f"t{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(_sliced(b, 512) for b in batches):
            keep = []
            (wa, pa_), (wb, pb) = word_hashes(batch.column("ta")), word_hashes(batch.column("tb"))
            for r in range(batch.num_rows):
                a, b = shingles(wa[pa_[r] : pa_[r + 1]], size), shingles(wb[pb[r] : pb[r + 1]], size)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(verify, "a long, b long")


def _sliced(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are not connected yet."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def _inside_buckets(members: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside buckets between members that are not connected yet.

    The members connected with the leader are connected with each other, so only the others are compared, with all members of
    the bucket. A task compares a block of the others with a block of members through the shingles they share, and returns at
    most two links to each component; these are confirmed on full sets like all links.
    """
    side = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    named = members.join(side("class_id"), "class_id", "left").join(side("leader"), "leader", "left")
    named = named.select(
        "band", "class_id", "n", F.coalesce("c_class_id", "class_id").alias("c"), F.coalesce("c_leader", "leader").alias("cl")
    )
    named = save(named.withColumn("odd", F.col("c") != F.col("cl")).drop("cl"), "named-members")
    # a bucket of two is its leader and one member, whose link was judged before
    weight = F.col("n") * np.dtype(np.uint32).itemsize
    sizes = [F.count(F.lit(1)).alias("k"), F.count_if("odd").alias("odds"), F.sum(weight).alias("bytes"), F.sum(F.when(F.col("odd"), weight)).alias("odd_bytes")]
    buckets = named.groupBy("band").agg(*sizes).where("odds > 0 and k > 2")
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    buckets = buckets.withColumns({"blocks": blocks, "rows": F.col("k") + F.col("odds"), "bytes": F.col("bytes") + F.col("odd_bytes")})
    # a bucket that fills much of a group, or has several blocks, shares its groups with no other
    alone = F.expr("blocks > 1") | (F.col("rows") > PART // 4) | (F.col("bytes") > PART_BYTES // 4)
    buckets = save(buckets.select("band", "blocks", "rows", "bytes", alone.alias("alone")), "buckets")
    rows, filled = buckets.where("not alone").agg(F.sum("rows"), F.sum("bytes")).first()
    parts = max(1, (rows or 0) // PART, (filled or 0) // PART_BYTES)
    opened = save(named.drop("n").join(buckets.drop("rows", "bytes"), "band"), "opened")
    nodes = opened.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    found = _texts(texts, classes, nodes)
    held = opened.join(found.mapInArrow(_setter(size), "class_id long, n long, held binary"), "class_id")
    block = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["band", "class_id", "c", "n", "held", "alone"]
    asking = held.where("odd").select(*columns, F.lit(True).alias("asks"), block.alias("i"), every.alias("j"))
    asked = held.select(*columns, F.lit(False).alias("asks"), every.alias("i"), block.alias("j"))
    whole = F.xxhash64("band", "i", "j")
    part = F.when(F.col("alone"), whole).otherwise(F.pmod(whole, F.lit(parts))).alias("part")
    pairs = asking.unionByName(asked).groupBy("alone", part).applyInPandas(_matcher(percent), "a long, b long")
    return _confirmed(save(pairs.distinct(), "pairs"), found, size, percent)


def _setter(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(_sliced(b, 512) for b in batches):
            words, at = word_hashes(batch.column("text"))
            held = [shingles(words[at[r] : at[r + 1]], size) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class_id"), pa.array([len(x) for x in held], pa.int64()),
                    pa.array([(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in held], pa.binary()),
                ],
                names=["class_id", "n", "held"],
            )

    return sets


def _matcher(percent: int):
    def match(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for _, bucket in group.groupby(["band", "i", "j"], sort=False):
            members, asking = bucket[~bucket["asks"]], bucket[bucket["asks"]]
            if len(members) and len(asking):
                out += _links(members, asking, percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return match


def _links(members: pd.DataFrame, asking: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of each asking class with members of other components, at most the two likeliest of each component."""
    out = []
    ids, label, n = (members[c].to_numpy() for c in ("class_id", "c", "n"))
    values = np.frombuffer(b"".join(members["held"]), np.uint32)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(ids)), n)[order]
    for a, c, size, held in asking[["class_id", "c", "n", "held"]].itertuples(index=False):
        held = np.frombuffer(held, np.uint32)
        low, high = np.searchsorted(values, held, "left"), np.searchsorted(values, held, "right")
        width = high - low
        place = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
        common = np.bincount(owner[place], minlength=len(ids))
        fits = np.flatnonzero((100 * common >= percent * (size + n - common)) & (label != c))
        fits = fits[np.argsort(-common[fits] / (size + n[fits] - common[fits]), kind="stable")]
        taken: dict[int, int] = {}
        for k in fits:
            taken[label[k]] = taken.get(label[k], 0) + 1
            if taken[label[k]] <= 2:
                out.append((min(a, ids[k]), max(a, ids[k])))
    return out
