"""Event sources of running streams, and tables that a running stream leaves behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_path


def read_events(spark: SparkSession, path: str, schema=None, files_per_batch: int | None = None) -> DataFrame:
    """A running stream of the Parquet files that match a path; files_per_batch bounds a micro-batch."""
    reader = spark.readStream.schema(schema if schema is not None else spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drained(stream: DataFrame, name: str = "stream", mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over all that its source has now and gives the rows it put out, as a table in the shared folder.

    each: a step on every micro-batch, as a batch table. Progress is checkpointed beside the rows, and a batch that is
    done again replaces its rows.
    """
    spark = stream.sparkSession
    root = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows").drop("batch")
