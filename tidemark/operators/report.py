"""Compiled results and the data behind the figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TESTS = ("kupiec", "cc", "ind", "as")


def compiled(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def _flags(table: DataFrame) -> list[str]:
    return [t for t in TESTS if f"{t}_passed" in table.columns]


def pass_summary(table: DataFrame) -> DataFrame:
    """Passes of each test by series and model, and how many tests there were."""
    names = _flags(table)
    return table.groupBy("series_id", "model").agg(
        *(F.sum(F.col(f"{t}_passed").cast("int")).alias(f"{t}_pass") for t in names), (F.count("alpha") * len(names)).alias("total_tests")
    )


def long_flags(table: DataFrame) -> DataFrame:
    names = _flags(table)
    rows = F.array(*(F.struct(F.lit(t).alias("test"), F.col(f"{t}_passed").alias("passed")) for t in names))
    return table.select("series_id", "model", "alpha", F.inline(rows))


def heatmap(table: DataFrame, series: list[str] | None = None, alphas: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """Models as rows; a column of 0 or 1 for each series, alpha and test. The
    names of the series, a column each, are given or looked up."""
    flags = long_flags(table)
    series = series or [r.series_id for r in table.select("series_id").distinct().orderBy("series_id").collect()]
    keys = [f"{s}|{a}|{t}" for s in series for a in alphas for t in _flags(table)]
    cell = F.concat_ws("|", "series_id", F.col("alpha").cast("string"), "test")
    return flags.withColumn("cell", cell).groupBy("model").pivot("cell", keys).agg(F.first(F.col("passed").cast("int")))


def ranking(table: DataFrame) -> DataFrame:
    """Models by passes, then by how near Z2 is to nothing."""
    names = _flags(table)
    passes = sum((F.col(f"{t}_passed").cast("int") for t in names), F.lit(0))
    s = table.groupBy("model").agg(F.sum(passes).alias("passes"), F.round(F.avg(F.abs("as_z2")), 6).alias("mean_abs_z2"))
    return s.select("*", F.rank().over(Window.orderBy(F.desc("passes"), "mean_abs_z2")).alias("rank"))


def bonferroni(table: DataFrame, significance: float = 0.05, comparisons: int = 48) -> DataFrame:
    rows = [F.struct(F.lit(t).alias("test"), F.col(f"{t}_p").alias("p")) for t in TESTS if f"{t}_p" in table.columns]
    long = table.select("series_id", "model", "alpha", F.inline(F.array(*rows)))
    return long.select("*", F.coalesce(F.col("p") >= significance / comparisons, F.lit(False)).alias("passed_corrected"))


def histogram(df: DataFrame, value: str, by: list[str], bins: int = 40) -> DataFrame:
    """Density of a value in equal bins between each group's least and most, its
    median, and the normal density of the group's mean and deviation there."""
    v = F.col(value)
    span = df.groupBy(*by).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.percentile(v, F.lit(0.5)).alias("median"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / width)).cast("int")
    got = df.join(span, by).where("hi > lo").withColumn("bin", at)
    got = got.groupBy(*by, "bin", "lo", "hi", "n", "m", "s", "median").agg(F.count(F.lit(1)).alias("k"))
    centre = F.col("lo") + width * (F.col("bin") + 0.5)
    normal = F.exp(-0.5 * F.pow((centre - F.col("m")) / F.col("s"), 2)) / (F.col("s") * 2.5066282746310002)
    return got.select(*by, "bin", centre.alias("centre"), (F.col("k") / (F.col("n") * width)).alias("density"), normal.alias("normal_density"), "median")
