"""An extension: daily summaries of an event stream, with late events until the watermark."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_summary(events: DataFrame, late: str = "2 days") -> DataFrame:
    """day, n, mean and maximum of value; works alike on streams and tables."""
    source = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("max"))
    return g.select(F.to_date("window.start").alias("day"), "n", "mean", "max")
