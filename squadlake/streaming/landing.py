"""Incremental landing: new files since the last run, landed once.

The stream's checkpoint plays the saved cursor: it is advanced after each
micro-batch, so a crash resumes at the batch that was under way.  Landing is
idempotent by hash, so replaying that batch (or deleting the checkpoint and
starting over) inserts nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squadlake.sources.bronze import BronzeTable, records_json


EMISSION_ORDER = ("_emitted", "_file", "_block")


def read_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """JSON-lines files as (payload, EMISSION_ORDER).  Rows of one block of a file come
    in the file's order, which landing keeps as their position."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder).select(
        F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("_emitted"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def read_parquet_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet drop folder as it is, for streams whose rows carry their emission order."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def read_table_stream(spark: SparkSession, folder: str, schema, max_files: int | None = None) -> DataFrame:
    """A Parquet drop folder as payload text."""
    return records_json(read_parquet_stream(spark, folder, schema, max_files))


def stream_land(stream: DataFrame, table: BronzeTable, *, source: str, endpoint: str, checkpoint: str,
                schema_version: str | None = None, order: Sequence[str] = EMISSION_ORDER):
    """Land everything that is available, then stop.  Returns the finished query.
    ``order`` names the emission-order columns of ``stream``."""
    def land(batch: DataFrame, number: int) -> None:
        table.land(batch, source=source, endpoint=endpoint, batch_id=f"{source}{endpoint}#{number}",
                   schema_version=schema_version, order=list(order))

    query = (stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
