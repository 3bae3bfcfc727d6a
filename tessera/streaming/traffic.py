"""Streaming versions of the traffic report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def traffic(events: DataFrame, ts: str = "ts", window: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Events by window and type; a watermark drops state once late events can't come."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(spark: SparkSession, source: str, sink: str, checkpoint: str) -> DataFrame:
    """All files of a folder through the stream, once; the sink holds what is final."""
    schema = spark.read.parquet(source).schema
    query = traffic(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)
