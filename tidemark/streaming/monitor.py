"""Streams: hourly bars by event time, and violations of standing limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Bars by event time; an hour closes when the watermark passes it."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return e.agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume"),
    ).select(F.col("event_type").alias("series_id"), F.col("window.start").alias("hour"), "open", "high", "low", "close", "volume")


def violations(returns: DataFrame, limits: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by day of streamed returns (series_id, ts, ret) below the standing
    VaR of limits (series_id, alpha, var), a static table."""
    r = returns.withWatermark("ts", late).join(limits, "series_id").where(F.col("ret") < -F.col("var"))
    return r.groupBy(F.window("ts", "1 day"), "series_id", "alpha").agg(F.count(F.lit(1)).alias("n_violations")).select("series_id", "alpha", F.col("window.start").alias("day"), "n_violations")
