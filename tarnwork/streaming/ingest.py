"""Structured Streaming: new readings and images as they arrive, late ones within a watermark, latest value for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def once_each(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, as long as repeats come within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, keys: list[str], time: str, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Count, mean and extremes for each key and tumbling window."""
    grouped = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, width).alias("window"))
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes what is there now and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
