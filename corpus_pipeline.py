"""From raw documents to token ids: toxic documents go, repeated lines go, one of each group of near copies stays, the sources
are mixed to target weights, and the texts are encoded. Every stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callweave.llm import line_dedup, mixing, near_dup, pieces, toxicity
from callweave.llm.support import WORD, read_documents, save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go. It learns from the labels of the documents that are here.

    A null text is judged as an empty one, which no term speaks against. Repeated rows go or stay together. Without labels of both
    kinds, all stay or go by the constant that is left; an empty table stays empty.
    """
    labels = spark.read.schema("doc_id bigint, toxic int").parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three lines go; every document stays, an emptied one with an empty text.

    Null texts stay null, and texts of fewer than three lines as they are. The first occurrence is that of the least ``doc_id`` (null
    last); rows that agree in id and text count as one and stay alike. An empty table stays empty.
    """
    return line_dedup.remove_repeated_lines(docs).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with like sets of five-word shingles stays, the one with the least id.

    Repeated rows are copies: one of them stays. Documents without a text or a word are linked with nothing and all stay. A null id
    stays only where its group has no other. An empty table stays empty.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), shingle=5, percent=80)
    found = save(found.select("doc_id", "mark", "class_id", "kept"), "found")
    # rows without words are linked with nothing, so each stays as it is
    kept = found.where("kept and class_id is not null").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "class_id")
    kept = kept.dropDuplicates(["_id", "class_id"]).drop("class_id")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark"))
    one = docs.join(kept, same)
    if found.groupBy("doc_id", "mark").count().where("count > 1").take(1):  # repeated rows are copies too
        one = one.dropDuplicates(["_id", "_mark"])
    blank = docs.where(F.col("text").isNull() | ~F.regexp_like("text", F.lit(WORD)))
    return one.select(docs.columns).unionByName(blank)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes of it, none or more. Rows that agree in id, source and text are copies
    of one row, and what is taken of all of them is taken of that.

    A null source is a source of its own. Documents without words, those of a null text among them, are taken once. Ties between
    documents of one size are broken by a hash of their ids. An empty table stays empty.
    """
    key = F.md5(F.concat(F.to_json(F.struct("doc_id", "source", F.col("text").isNull().alias("n"))), F.coalesce("text", F.lit(""))))
    taken = mixing.mix_sources(docs.withColumn("_key", key), carry=("_key",))
    taken = save(taken.groupBy("_key").agg(F.sum("copies").cast("int").alias("_copies")).where("_copies > 0"), "taken")
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    dealt = docs.withColumn("_key", key).join(taken, "_key").withColumn("_first", first).where("_first = 1")
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, in one row or, for a giant text, several chunks.

    A null text has null ids, an empty one none; repeated rows are encoded each. An empty table gives no rows.
    """
    return pieces.encode_texts(docs.select("doc_id", "lang", "source", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_to_weights),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier and the entropy balancing are fitted by iteration, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.split()[0])
    return docs
