"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.session import scratch_path

#: A word is a longest run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id is in fold -1, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shield(df: DataFrame, inner: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with new names for columns whose names an operator uses inside, and the names that give them back at its end."""
    back: dict[str, str] = {}
    for column in [c for c in df.columns if c.lower() in inner]:
        given = free_name(df, f"given_{column.lower()}")
        df, back = df.withColumnRenamed(column, given), {**back, given: column}
    return df, back


def arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows as Python values: integers stay integers beside nulls."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


_ARROW = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def arrow_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of ``schema``, whose fields are of the types above."""
    fields = [field.split() for field in schema.split(", ")]
    columns = [pa.array(values, _ARROW[kind]) for values, (_, kind) in zip(zip(*rows), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])
