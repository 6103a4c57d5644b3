"""The topic catalogue: name and description of each topic, with a stable number."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.constants import MAX_BROADCAST_BYTES
from callweave.session import materialise


@dataclass
class Catalogue:
    """Topics, ``topic_no, topic, description``, and whether they are few enough to be broadcast; else they are matched in blocks of
    about ``block_bytes``."""

    topics: DataFrame
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES
    block_bytes: int = MAX_BROADCAST_BYTES

    @cached_property
    def size_bytes(self) -> int:
        """Size of the catalogue's text, measured once by a small aggregate."""
        size = self.topics.agg(F.sum(F.octet_length("description") + F.octet_length("topic") + 8)).first()[0]
        return int(size or 0)

    @property
    def is_small(self) -> bool:
        return self.size_bytes <= self.max_broadcast_bytes

    @property
    def blocks(self) -> int:
        return max(1, -(-self.size_bytes // self.block_bytes))

    def name(self, matches: DataFrame, *columns: str) -> DataFrame:
        """Add topic columns to rows with a ``topic_no``; broadcast if small, else left to the optimizer."""
        side = self.topics.select("topic_no", *columns)
        return matches.join(F.broadcast(side) if self.is_small else side, "topic_no")


def read_catalogue(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Read ``{name: description}`` JSON as ``topic_no, topic, description``, one object per file or, with ``whole_file`` off, one per line.

    Topics are numbered through the whole source, by file name, place in the file and order of writing, so a number means
    one topic. Of a name written twice the first place and the last description count. Text that is no such object raises.
    Only the number of topics of each object is summed up in one place, first within the part of a file that a task reads.
    """
    object_of = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    raw = spark.read.text(path, wholetext=whole_file).where(F.lit(whole_file) | (F.trim("value") != ""))
    parsed = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        F.map_entries(F.coalesce(object_of, F.raise_error(F.concat(F.lit("no topic catalogue: "), F.substring("value", 1, 80))).cast("map<string,string>"))).alias("entries"),
    )
    parsed = materialise(parsed, "catalogue-objects")
    size = F.size("entries")
    blocks = parsed.groupBy("file", "block").agg(F.sum(size).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ahead = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    numbered = parsed.withColumn("ahead", F.coalesce(F.sum(size).over(ahead), F.lit(0))).join(blocks, ["file", "block"])
    topics = numbered.select((F.col("first") + F.col("ahead")).alias("start"), F.posexplode("entries").alias("place", "entry")).select(
        (F.col("start") + F.col("place")).alias("no"), F.col("entry.key").alias("topic"), F.col("entry.value").alias("description")
    )
    return topics.groupBy("topic").agg(F.min("no").alias("topic_no"), F.max_by("description", "no").alias("description")).select(
        "topic_no", "topic", "description"
    )


def catalogue_from_table(table: DataFrame, number: str, description: str) -> Catalogue:
    """A catalogue kept as a table; its key serves as topic number and name."""
    return Catalogue(
        table.select(
            F.col(number).cast("bigint").alias("topic_no"),
            F.col(number).cast("string").alias("topic"),
            F.col(description).alias("description"),
        )
    )
