"""Line dedup: later occurrences of three consecutive lines go, wherever they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.support import BLANKS, save, shield

WINDOW = 3  # consecutive lines
_INNER = ("_mark", "_all", "_left", "_spans")


def remove_repeated_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) with the repeated lines taken out of ``text``, and ``_lines, _removed``, their numbers.

    Lines are what ``\\n`` separates; blank ones are passed over, and blanks at both ends are ignored. All overlapping windows of
    ``window`` lines are hashed (128 bits). Of the occurrences of a window over all documents the first one stays, by
    ``doc_id`` (null last), hash of the text and place; all others are covered, blank lines between included, and
    covered lines are removed. One window with any number of occurrences is reduced before it is shuffled, and the join
    that marks the others can be split. Texts are shuffled once, at any size: what is covered grows with them.

    Every row comes back, an emptied document with an empty text. A text with fewer lines than a window stays as it is, a
    null text stays null. Rows that agree in ``doc_id`` and text count as one occurrence, so repeated rows stay alike.
    ``n_chars``, where there is one, is set to the new length; other columns are carried along, whatever their names, but for
    ``_lines`` and ``_removed``, which are replaced. An empty table gives an empty one.
    """
    docs, back = shield(docs, _INNER)
    key = [F.col("doc_id"), F.xxhash64("text").alias("_mark")]
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    listed = docs.where(F.col("text").isNotNull()).select(*key, F.filter(lines, lambda x: x["line"] != "").alias("_l"))
    line = lambda k, d: F.get("_l", k + d)
    hashed = lambda k, seed: F.xxhash64(F.lit(seed), *[line(k, d)["line"] for d in range(window)])
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_l") - window),
        lambda k: F.struct(
            line(k, 0)["i"].alias("at"), line(k, window - 1)["i"].alias("to"), hashed(k, 1).alias("h1"), hashed(k, 2).alias("h2")
        ),
    )
    placed = listed.where(F.size("_l") >= window).select("doc_id", "_mark", F.explode(windows).alias("_w"))
    placed = save(placed.select("doc_id", "_mark", "_w.at", "_w.to", "_w.h1", "_w.h2"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_mark", "at")
    # a window occurs twice where its least and greatest place differ
    firsts = placed.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").drop("last")
    later = placed.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "_mark").agg(F.collect_set(F.struct("at", "to")).alias("_spans"))
    covered = save(covered, "covered")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d._mark") == F.col("c._mark"))
    joined = docs.withColumn("_mark", F.xxhash64("text")).alias("d").join(covered.hint("merge").alias("c"), same, "left").select("d.*", "c._spans")
    split = joined.withColumn("_all", F.split("text", "\n"))
    hidden = F.flatten(F.transform("_spans", lambda s: F.sequence(s["at"], s["to"])))  # overlapping spans merge as sets
    split = split.withColumn("_left", F.array_except(F.sequence(F.lit(0), F.size("_all") - 1), hidden))
    changed = F.col("_spans").isNotNull()
    out = split.withColumns(
        {
            "text": F.when(changed, F.array_join(F.transform("_left", lambda i: F.get("_all", i)), "\n")).otherwise(F.col("text")),
            "_lines": F.coalesce(F.size("_all"), F.lit(0)).cast("bigint"),
            "_removed": F.when(changed, F.size("_all") - F.size("_left")).otherwise(0).cast("bigint"),
        }
    ).drop("_all", "_left", "_spans", "_mark")
    out = out.withColumnsRenamed(back)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out
