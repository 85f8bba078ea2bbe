"""An extension: event streams with watermarks and windows. The tables to be matched have no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of value by window and type; rows later than the watermark are dropped. Batch or stream."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    if stream.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
