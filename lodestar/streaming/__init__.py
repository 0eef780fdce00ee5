"""Streaming entry to the batch operators.

The operators are plain functions of DataFrames, so those without a global sort or a self-join also
take a streaming DataFrame. This module only adds the reader and a watermarked windowed aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files_each: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def windowed(stream: DataFrame, time: str, size: str, late: str, keys: list[str], **columns: Column) -> DataFrame:
    """Aggregates per time window and keys; windows close once they are later than the watermark."""
    at = F.window(time, size)
    return stream.withWatermark(time, late).groupBy(at, *keys).agg(*[c.alias(n) for n, c in columns.items()]).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *columns)
