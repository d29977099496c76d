"""Returns, their description, and checks between series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import scans

def _by_date():
    return Window.partitionBy("series_id").orderBy("date")


def log_returns(prices: DataFrame, width: int = scans.WIDTH) -> DataFrame:
    """(series_id, date, t, price, ret): ln(p / previous p) where both are
    positive; other days have no row, and t counts the rest from 1. The previous
    price is that of the previous row, so a missing one costs two returns. Both
    are scans by buckets of width days, so a long series is many tasks."""
    rows = scans.bucketed(prices.select("series_id", "date", "price"), "date", width)
    r = scans.scanned(rows, ("series_id",), ["date"], "price", lambda p, before: (p > 0) & (before > 0), before="before", t="number")
    return r.where("t is not null").select("series_id", "date", "t", "price", F.log(F.col("price") / F.col("before")).alias("ret"))


def non_positive(prices: DataFrame) -> DataFrame:
    return prices.where("price <= 0")


def flagged(returns: DataFrame, dates: tuple[str, ...]) -> DataFrame:
    """Returns on flagged days, which stay in the sample."""
    return returns.where(F.col("date").isin([F.lit(d).cast("date") for d in dates]))


def without(returns: DataFrame, dates: tuple[str, ...]) -> DataFrame:
    """The robustness variant: flagged days left out and t counted anew."""
    kept = returns.where(~F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    return kept.withColumn("t", F.row_number().over(_by_date()))


def summary(returns: DataFrame) -> DataFrame:
    n = F.count("ret").cast("double")
    return returns.groupBy("series_id").agg(
        F.count("ret").alias("n_obs"), F.min("date").alias("start"), F.max("date").alias("end"), F.round(F.avg("ret"), 6).alias("mean"),
        F.round(F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), 4).alias("ann_vol"),
        F.round(stats.skewness(n, F.skewness("ret")), 4).alias("skewness"), F.round(stats.excess_kurtosis(n, F.kurtosis("ret")), 4).alias("excess_kurtosis"),
    )


def aligned(returns: DataFrame, prices: DataFrame) -> DataFrame:
    """Returns with the price of their day, or else the last one before."""
    p = prices.select("series_id", "date", F.col("price").alias("found"))
    filled = F.last("found", ignorenulls=True).over(_by_date().rowsBetween(Window.unboundedPreceding, 0))
    return returns.drop("price").join(p, ["series_id", "date"], "left").withColumn("price", filled).drop("found")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n rows of each series by date."""
    last = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date")))
    return rows.withColumn("_last", last).where(F.col("_last") <= n).drop("_last")


def five_sigma(returns: DataFrame, times: float = 5.0) -> DataFrame:
    w = Window.partitionBy("series_id")
    d = returns.select("*", F.avg("ret").over(w).alias("mean"), F.stddev_samp("ret").over(w).alias("std"))
    return d.where(F.abs(F.col("ret") - F.col("mean")) > times * F.col("std"))


def cross_validated(primary: DataFrame, other: DataFrame) -> DataFrame:
    """By series: common days, correlation of prices, mean absolute relative
    difference, and how many are equal."""
    both = primary.select("series_id", "date", F.col("price").alias("a")).join(other.select("series_id", "date", F.col("price").alias("b")), ["series_id", "date"]).where("a is not null and b is not null")
    return both.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("corr"), F.avg(F.abs(F.try_divide("a", "b") - 1)).alias("mean_abs_diff"), F.count_if(F.col("a") == F.col("b")).alias("n_equal")
    )


def shifted(primary: DataFrame, other: DataFrame, shifts: tuple[int, ...] = (-1, 0, 1)) -> DataFrame:
    """cross_validated()'s correlation with the other series moved by rows."""
    moved = [F.struct(F.lit(k).alias("shift"), (F.lag("price", k) if k >= 0 else F.lead("price", -k)).over(_by_date()).alias("b")) for k in shifts]
    o = other.select("series_id", "date", F.array(*moved).alias("m")).select("series_id", "date", F.inline("m"))
    both = primary.select("series_id", "date", F.col("price").alias("a")).join(o, ["series_id", "date"]).where("a is not null and b is not null")
    return both.groupBy("series_id", "shift").agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("corr"), F.avg(F.abs(F.try_divide("a", "b") - 1)).alias("mean_abs_diff"))


def zero_volume_moves(bars: DataFrame, large: float) -> DataFrame:
    """By series: share of days without volume, and how often a move above
    large follows such a day and any day."""
    p = bars.select("series_id", "date", "volume", F.col("close").alias("price"))
    before = F.lag("price").over(_by_date())
    p = p.withColumn("ret", F.when((F.col("price") > 0) & (before > 0), F.log(F.col("price") / before)))
    nxt = (F.abs(F.lead("ret").over(_by_date())) > large).cast("double")
    return p.withColumn("next_large", nxt).groupBy("series_id").agg(
        F.avg((F.col("volume") == 0).cast("double")).alias("zero_share"), F.avg(F.when(F.col("volume") == 0, F.col("next_large"))).alias("after_zero"), F.avg("next_large").alias("base_rate")
    )


def in_bands(returns: DataFrame, bands: dict[str, tuple[str, str]]) -> DataFrame:
    """Returns in percent with the crisis band of their day, if any; a band ends
    with the series at the latest. bands is a table of constants."""
    spark = returns.sparkSession
    rows = [(k, a, b) for k, (a, b) in bands.items()]
    b = spark.createDataFrame(rows, "band string, a string, b string").select("band", F.to_date("a").alias("band_start"), F.to_date("b").alias("band_end"))
    at = (F.col("date") >= F.col("band_start")) & (F.col("date") <= F.col("band_end"))
    last = F.max("date").over(Window.partitionBy("series_id"))
    return returns.withColumn("last", last).join(F.broadcast(b), at, "left").select(
        "series_id", "date", (F.col("ret") * 100).alias("ret_pct"), "band", F.least("band_end", "last").alias("band_end")
    )
