"""Mixing sources to target weights by entropy balancing.

Among all rates that give each source its target number of words, and that repeat no document more than ``MAX_COPIES``
times, entropy balancing takes those nearest to one copy of everything: it minimises the sum over documents of
``r log r - r + 1``. The dual of this problem is convex with one multiplier for each source's token constraint, and its
solution tilts the documents exponentially: ``r = min(MAX_COPIES, exp(multiplier * size))``. Newton steps on the dual run as
aggregations over a histogram of sizes, and the rates are then rounded to whole copies.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callweave.llm.support import WORD, save

MAX_COPIES = 2  # no document is taken more often, so no source can give more than this many times its words
WEIGHTS = (3, 1, 2)  # weights of the sources in order, repeating
SHARE = 1.5  # the mix holds this many times the words of all sources
MAX_STEPS = 80
TOLERANCE = 1e-9  # of a source's target
SLICES = 256  # documents of one source and size are ranked in so many slices


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, rate, copies, taken``: one row for each row of ``docs``.

    ``docs`` has ``doc_id, text, source``; other columns are not read. A null or empty text has size 0, rate 1 and one
    copy, which takes no word. A null source is a source of its own, last in order. Repeated rows and repeated or null ids
    count as separate documents; columns named in ``carry`` are carried along; of documents that agree in source, size and id it does not matter which is taken. An
    empty table gives no rows. Sources are told apart by code points. Only sizes are shuffled, never texts.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # joins like any string, also for a null source
    sized = save(docs.select("doc_id", key.alias("key"), size.alias("size"), *carry), "sizes")
    histogram = save(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    targets = save(source_targets(histogram, weights, share, max_copies), "targets")
    classes = save(round_copies(histogram, balance(histogram, targets, max_copies), max_copies), "copies")
    return _deal(sized, classes).select(
        "doc_id", F.when(F.col("key") != "", F.substring("key", 2, 2147483647)).alias("source"), "size", "source_size",
        "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"), *carry,
    )


def source_targets(histogram: DataFrame, weights: tuple[float, ...], share: float, max_copies: int) -> DataFrame:
    """``key, source_size, target``: the shares by weight, stopped at ``max_copies`` times a source's size.

    Let ``level`` be the words per unit of weight. A source stops where its bound lies below ``level * weight``; the level is
    then taken anew from what the other sources share, until it stays. Each round is one small aggregation.
    """
    sources = histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    order = sources.orderBy(F.col("key") == "", "key").rdd.zipWithIndex()  # a distributed sort and count, a row a source
    sources = histogram.sparkSession.createDataFrame(
        order.map(lambda x: (*x[0], x[1])), "key string, source_size bigint, place bigint"
    )
    sources = save(sources, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    bound = F.lit(float(max_copies)) * F.col("source_size")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # the level only rises, so at least one more source stops in each round
        stops = bound <= F.lit(level) * weight
        row = sources.agg(
            F.sum(F.when(stops, bound)), F.sum(F.when(~stops, weight)), F.count_if(stops)
        ).first()
        if row[2] == stopped or not row[1]:
            break
        stopped, level = row[2], max(level, (total - (row[0] or 0.0)) / row[1])
    return sources.select("key", "source_size", F.least(bound, F.lit(level) * weight).alias("target"))


def balance(histogram: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``targets`` with ``unit`` and ``tilt`` (null for a source without words): the rate of a document is ``min(max_copies, exp(tilt * size / unit))``.

    Newton steps on the dual, kept inside a bracket that closes with every step; a step that leaves it is replaced by the
    middle. A step is one aggregation of gradient and curvature over the histogram for all sources at once.
    """
    top = math.log(max_copies)
    positive = histogram.where("size > 0")
    shape = positive.groupBy("key").agg(
        F.min("size").alias("least"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("unit")
    )
    ratio = F.col("target") / F.col("source_size")
    least = F.col("least") / F.col("unit")
    low = F.when(ratio < 1, F.log(F.greatest(ratio, F.lit(1e-300))) / least).otherwise(0.0)
    high = F.when(ratio > 1, top / least).otherwise(0.0)
    state = targets.join(shape, "key").select(
        *targets.columns, "unit", low.alias("low"), high.alias("high"),
        F.when(ratio >= max_copies, high).otherwise(0.0).alias("tilt"), F.lit(1.0).alias("off"),
    )
    state = save(state, "tilt")
    mean = F.col("size") / F.col("unit")
    power = F.col("tilt") * mean
    rate = F.when(power < top, F.exp(power)).otherwise(float(max_copies))
    words = F.col("n") * F.col("size") * rate
    for _ in range(MAX_STEPS):
        sums = positive.join(state, "key").groupBy("key").agg(
            F.sum(words).alias("words"), F.sum(F.when(power < top, words * mean)).alias("slope")
        )
        gap = F.col("words") - F.col("target")
        low = F.when(gap <= 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        done = F.abs(gap) <= TOLERANCE * F.col("target")
        step = F.when(done, F.col("tilt")).when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        off = F.when(done, 0.0).otherwise(F.abs(step - F.col("tilt")))
        state = state.join(sums, "key").select(
            *targets.columns, "unit", low.alias("low"), high.alias("high"), step.alias("tilt"), off.alias("off")
        )
        state = save(state, "tilt")
        if not state.agg(F.max("off")).first()[0]:
            break
    else:
        raise RuntimeError(f"the sources' tilts did not settle in {MAX_STEPS} steps")
    return targets.join(state.select("key", "unit", "tilt"), "key", "left")


def round_copies(histogram: DataFrame, tilts: DataFrame, max_copies: int) -> DataFrame:
    """``key, size, source_size, target, rate, base, extra``: of the documents of one source and size, ``extra`` get
    ``base + 1`` copies and the others ``base``.

    First by running sums over the sizes, largest first, which leaves an error below the largest size. Then what a
    source still lacks or has in excess is moved in its smallest documents.
    """
    power = F.col("tilt") * F.col("size") / F.col("unit")
    rate = F.when((F.col("size") == 0) | F.col("tilt").isNull(), 1.0).otherwise(F.least(F.exp(F.least(power, F.lit(700.0))), F.lit(float(max_copies))))
    rated = histogram.join(tilts, "key").select("key", "size", "n", "source_size", "target", rate.alias("rate"))
    w = Window.partitionBy("key")
    down, up = w.orderBy(F.desc("size")), w.orderBy(F.col("size"))
    upto = F.round(F.sum(F.col("n") * F.col("rate")).over(down), 6)
    dealt = rated.withColumn("upto", F.floor(upto + 0.5).cast("bigint"))
    dealt = dealt.withColumn("given", F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)))
    dealt = dealt.withColumn("given", F.greatest(F.lit(0), F.least("given", F.col("n") * max_copies)))
    lack = F.floor(F.col("target") + 0.5).cast("bigint") - F.sum(F.col("given") * F.col("size")).over(w)
    room = F.when(F.col("size") == 0, 0).when(F.col("lack") > 0, F.col("n") * max_copies - F.col("given")).otherwise(F.col("given"))
    dealt = dealt.withColumn("lack", lack).withColumn("room", room)
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    move = F.greatest(F.lit(0), F.least(F.col("room"), F.floor((F.abs("lack") - F.col("before")) / F.greatest("size", F.lit(1)))))
    dealt = dealt.withColumn("before", before).withColumn("given", F.col("given") + F.signum("lack").cast("bigint") * move.cast("bigint"))
    return dealt.select(
        "key", "size", "source_size", "target", "rate",
        F.floor(F.col("given") / F.col("n")).cast("bigint").alias("base"), (F.col("given") % F.col("n")).alias("extra"),
    )


def _deal(sized: DataFrame, classes: DataFrame) -> DataFrame:
    """Give the extra copies of a class to its first documents by hash: slices are counted first, so that a class with a
    third of all documents is ranked by many tasks."""
    mark = F.xxhash64(F.col("doc_id"), F.lit("mix"))
    marked = sized.withColumn("mark", mark).withColumn("slice", F.pmod("mark", F.lit(SLICES)).cast("int"))
    counts = marked.groupBy("key", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    ahead = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("m").over(ahead), F.lit(0)))
    left = (F.col("extra") - F.col("ahead")).alias("left")
    shares = counts.join(classes, ["key", "size"]).select(
        "key", "size", "slice", "source_size", "target", "rate", "base", left
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("mark", "doc_id"))
    copies = F.col("base") + (F.col("rank") <= F.col("left")).cast("bigint")
    return marked.withColumn("rank", rank).join(shares, ["key", "size", "slice"]).withColumn("copies", copies)
