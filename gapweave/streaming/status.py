"""Observations as a stream, judged against a batch climatology; equal to the batch result (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr


def judged(stream: DataFrame, norms: DataFrame, by: list[str], delay: str = "2 days") -> DataFrame:
    """Rows (by, ts, value) once each, with z and status from the norms (by, clim_mean, clim_std)."""
    once = stream.withWatermark("ts", delay).dropDuplicates([*by, "ts"])
    z = F.try_divide(F.col("value") - F.col("clim_mean"), F.col("clim_std"))
    out = once.join(norms, by, "left").withColumn("z", z)
    return out.withColumn("status", expr.status(F.col("z")))


def daily(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts and sums of events by day and type; late rows within the delay count."""
    days = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return days.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date(F.col("w.start")).alias("day"), "event_type", "n", "total")
