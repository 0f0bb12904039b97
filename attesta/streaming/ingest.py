"""Structured Streaming over newly landed observations; an extension over batch runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def observations(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 64) -> DataFrame:
    """Parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Counts by event time; state older than the watermark is dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_sightings(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Repetitions within the watermark are dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Run the same DataFrame functions as batch jobs on every micro-batch until the source is drained."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
