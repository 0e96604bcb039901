"""Token summaries over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, *, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tokens, mean and highest score of each event type by window of event time; works on batches and streams.

    Takes columns ts, event_type and value; rows later than ``late`` behind the newest are left out of a stream.
    """
    score = F.col("value") / (F.col("value") + 50)
    rows = stream.withWatermark("ts", late).withColumn("score", score)
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("score").alias("s_mean"), F.max("score").alias("s_max"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "s_mean", "s_max")
