"""Price series from files and from the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("date", "close", "high", "low", "open", "volume")


def read_csv(spark: SparkSession, path: str, series_id: str, wide: bool | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A price file as (series_id, date, close, high, low, open, volume).

    All fields are read as text. Rows whose first field is not a date of the
    given format are left out, which takes away header rows however many; what
    is not a number becomes null. wide: Date, Close, High, Low, Open, Volume;
    else Date and Close. Where it is not given, it holds if one of the first
    five rows has five fields or more.
    """
    if wide is None:
        fields = spark.read.text(path).limit(5).select(F.size(F.split("value", ",")).alias("n"))
        wide = (fields.agg(F.max("n")).first()[0] or 0) >= 5
    names = COLUMNS if wide else COLUMNS[:2]
    raw = spark.read.schema(", ".join(f"{c} string" for c in names)).option("mode", "PERMISSIVE").csv(path)
    shape = F.regexp_replace(F.lit(date_format), "[yMd]", "9").alias("shape")
    day = F.trim("date")
    whole = F.regexp_replace(day, "[0-9]", "9") == shape
    kept = raw.where(whole).select(F.lit(series_id).alias("series_id"), F.try_to_timestamp(day, F.lit(date_format)).cast("date").alias("date"), *(
        F.expr(f"try_cast(trim({c}) as double)").alias(c) if c in names else F.lit(None).cast("double").alias(c) for c in COLUMNS[1:]
    ))
    numbers = {c: F.when(~F.isnan(c), F.col(c)) for c in COLUMNS[1:]}
    return kept.where("date is not null").withColumns(numbers)


def prices(bars: DataFrame, start: str | None = None, end: str | None = None, mask_zero_volume: bool = False) -> DataFrame:
    """(series_id, date, price) of bars within the inclusive dates; with the
    mask, days without volume keep their row but not their price."""
    if start:
        bars = bars.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("date") <= F.lit(end).cast("date"))
    price = F.when(F.col("volume") == 0, None).otherwise(F.col("close")) if mask_zero_volume else F.col("close")
    return bars.select("series_id", "date", price.cast("double").alias("price"))


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders, a series a priority: the mean price, and as volume
    the orders that are finished."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("close"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("volume")
    )


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of lineitem, a series a return flag."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.avg("l_extendedprice"), 6).alias("close"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.count(F.lit(1)).alias("volume")
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events, a series a type, open and close by time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("hour")).agg(
        F.min_by("value", F.struct("ts", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.count(F.lit(1)).alias("volume"),
    )
