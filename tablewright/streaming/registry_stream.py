"""The registry as a stream: an extension beyond batch reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def status_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events of each status by day; repeats of an id within the watermark count once."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return rows.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
