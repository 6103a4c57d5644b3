"""Calls arriving as files dropped into a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.sources.sinks import add_to_run
from callweave.sources.transcripts import CALLS_SCHEMA


def process_new_drops(
    spark: SparkSession,
    drop_dir: str,
    transform: Callable[[DataFrame], DataFrame],
    out_dir: str,
    checkpoint_dir: str,
    run_date: str,
    schema: T.StructType = CALLS_SCHEMA,
    files_per_batch: int = 1000,
) -> None:
    """Process every file that has not been processed yet, then stop. A backlog is taken in batches of files.

    The checkpoint remembers the files of each batch. A batch is a DataFrame of its own, so ``transform`` may be any job, and its result
    is added to the run of ``run_date`` under the number of the batch. A batch that is run again, because the job ended
    between the result and the checkpoint, is recognised by that number and not added twice; what an attempt that ended
    early wrote is not named in the run's log and thus never read. ``sources.sinks.read_runs`` reads what was found, as the topic job does.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        version = f"{_stream_id(batch.sparkSession, checkpoint_dir)}-{batch_id}"
        add_to_run(transform(batch), out_dir, run_date, version)

    drops = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(drop_dir)
    query = drops.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    query.awaitTermination()


def _stream_id(spark: SparkSession, checkpoint_dir: str) -> str:
    """The id that the stream keeps in its checkpoint: a new checkpoint is a new stream, with batches of its own."""
    return spark.read.text(f"{checkpoint_dir.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
