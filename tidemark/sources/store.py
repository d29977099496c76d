"""Forecast and result tables: steps that are saved once, and CSV results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in spark.checkpoint.dir, read again: what several
    steps read is made once, and outlives lost executors. Where the session names
    no such folder, a temporary one serves, on a local master only."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[spark.sparkContext.applicationId] = at
    path = f"{at.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class ForecastStore:
    """Forecasts as Parquet, partitioned by model, series and part, and beside
    them a manifest with a row for each part that is whole.

    A part is written by overwriting its own folder, then entered. What is lost
    in between is written again in the same place, so nothing is there twice, and
    parts that are entered are not made again.
    """

    KEY = ("series_id", "model", "alpha", "t")
    ENTRY = "model string, series_id string, part int, days long, due int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, path: str, schema: str | None = None) -> DataFrame | None:
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def load(self) -> DataFrame | None:
        """All forecasts of parts that are entered (a part that is not may be of a
        run that was lost)."""
        have = self._read(self.path)
        if have is None:
            return None
        have = have.withColumn("series_id", F.col("series_id").cast("string"))
        return have.join(self.entered().select("model", "series_id", "part").distinct(), ["model", "series_id", "part"], "left_semi").drop("part")

    def entered(self) -> DataFrame:
        """The manifest's last row of each part."""
        m = self._read(f"{self.path}_manifest", self.ENTRY + ", at timestamp")
        if m is None:
            return self.spark.createDataFrame([], self.ENTRY)
        last = F.max_by(F.struct("days", "due"), F.struct("at", "days")).alias("x")
        return m.groupBy("model", "series_id", "part").agg(last).select("model", "series_id", "part", "x.days", "x.due")

    def save(self, forecasts: DataFrame, entries: DataFrame) -> None:
        """forecasts with their part, then entries (as ENTRY) of all of them."""
        forecasts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "series_id", "part").parquet(self.path)
        entries.select("model", "series_id", "part", "days", F.col("due").cast("int").alias("due"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{self.path}_manifest")

    def open_parts(self, model: str, days: DataFrame) -> DataFrame:
        """Of days (series_id, part, t) the parts (series_id, part, days) that are
        not entered with as many days."""
        want = days.groupBy("series_id", "part").agg(F.count(F.lit(1)).alias("days"))
        return want.join(self.entered().where(F.col("model") == model).select("series_id", "part", "days"), ["series_id", "part", "days"], "left_anti")

    def counts(self) -> DataFrame | None:
        have = self.load()
        return None if have is None else have.groupBy("series_id", "model", "alpha").agg(F.count(F.lit(1)).alias("n"))


def write_csv(df: DataFrame, path: str) -> None:
    """A result table, small by its nature, as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_prices(prices: DataFrame, path: str) -> None:
    """Processed prices without nulls, a partition a series."""
    prices.where("price is not null").write.mode("overwrite").partitionBy("series_id").parquet(path)
