"""Extension: micro-batches of events appended to a cube of time buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_stream(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums for each key and bucket; buckets close once the watermark passes them."""
    agg = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return agg.select(F.col("window.start").alias(time), *keys, "n", "total")


def append_slices(stream: DataFrame, path: str, checkpoint: str, by: str):
    """A query that appends closed buckets to a partitioned store."""
    return stream.withColumn("slice", F.to_date(by)).writeStream.outputMode("append").format("parquet").partitionBy("slice").option("checkpointLocation", checkpoint).start(path)
