"""Frames per interval on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_per_stream(frames: DataFrame, interval: str = "1 minute", late: str | None = None, by: str = "source_id") -> DataFrame:
    """Counts per source and tumbling window of event time (windows start at multiples of the interval; a stream has no
    first frame to anchor them to). Late rows always count unless ``late`` says how long a window waits."""
    f = frames.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("tm_ns"), F.lit(1000))))
    if late is not None:
        f = f.withWatermark("ts", late)
    return f.groupBy(by, F.window("ts", interval).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

