"""Replay of a stream of deliveries.

Nothing is dropped for being late, so no streaming watermark is set. Each micro
batch is appended to a log, one folder per batch number, which makes a batch
that runs twice harmless; a snapshot is then a function of the log and an
instant, and the batch operators serve unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tideclock.operators import clocks as C, replay as R


def append_batch(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that stores each batch under its number, replacing a former try."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return store


def start(spark: SparkSession, source: str, schema: StructType, folder: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Follow a folder of Parquet deliveries; stops when what is there has been taken."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return rows.writeStream.foreachBatch(append_batch(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_log(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", folder).parquet(folder).select(*schema.names)


def snapshot_states(catalog: DataFrame, log: DataFrame, as_of: int) -> DataFrame:
    found = C.case_clocks(catalog, R.classify(log, as_of), as_of)
    return found.select("case_id", "service_group", "state", "projection_revision")


def replay_in_batches(catalog: DataFrame, log: DataFrame, as_of: int, batches: int) -> DataFrame:
    """The case states at ``as_of`` after the log has come in as a stream of files."""
    from tideclock.sources.tables import scratch_folder

    spark = log.sparkSession
    source, folder = scratch_folder(spark, "stream-in"), scratch_folder(spark, "stream-log")
    cut = log.withColumn("part", F.pmod(F.xxhash64("delivery_seq"), F.lit(batches)))
    cut.repartition(batches, "part").drop("part").write.parquet(source)
    start(spark, source, log.schema, folder, scratch_folder(spark, "stream-state")).awaitTermination()
    return snapshot_states(catalog, stored_log(spark, log.schema, folder), as_of)
