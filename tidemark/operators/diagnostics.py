"""Descriptive diagnostics of return series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Asymptotic critical values of the unit-root test with a constant.
ADF_CRITICAL = {0.01: -3.43, 0.05: -2.86, 0.10: -2.57}


def hill(returns: DataFrame, k: int = 100) -> DataFrame:
    """Tail index of absolute returns from the k largest; null under k + 1."""
    w = Window.partitionBy("series_id").orderBy(F.desc("a"), "t")
    top = returns.select("series_id", "t", F.abs("ret").alias("a")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    s = top.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("rank") <= k, F.log("a"))).alias("s"), F.max(F.when(F.col("rank") == k + 1, F.log("a"))).alias("x"))
    return s.select("series_id", F.when(F.col("n") == k + 1, 1 / (F.col("s") / k - F.col("x"))).alias("hill"))


def jarque_bera(returns: DataFrame) -> DataFrame:
    jb = F.count("ret") / 6 * (F.pow(F.skewness("ret"), 2) + F.pow(F.kurtosis("ret"), 2) / 4)
    return returns.groupBy("series_id").agg(F.count("ret").alias("n"), jb.alias("jb")).select("*", F.exp(-F.col("jb") / 2).alias("p"))


def acf(returns: DataFrame, lags: int = 40, squared: bool = True) -> DataFrame:
    """(series_id, lag, acf): one window with all lags, one aggregation."""
    x = F.col("ret") * F.col("ret") if squared else F.col("ret")
    w = Window.partitionBy("series_id")
    d = returns.select("series_id", "t", (x - F.avg(x).over(w)).alias("d"))
    o = w.orderBy("t")
    pairs = d.select("series_id", "d", *(F.lag("d", k).over(o).alias(f"d{k}") for k in range(1, lags + 1)))
    sums = pairs.groupBy("series_id").agg(F.sum(F.col("d") * F.col("d")).alias("v"), *(F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)))
    rows = F.array(*(F.struct(F.lit(k).alias("lag"), (F.try_divide(f"c{k}", "v")).alias("acf")) for k in range(1, lags + 1)))
    return sums.select("series_id", F.inline(rows))


def ljung_box(returns: DataFrame, lags: int = 10, squared: bool = False) -> DataFrame:
    n = returns.groupBy("series_id").agg(F.count("ret").alias("n"))
    q = F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))
    return acf(returns, lags, squared).join(n, "series_id").groupBy("series_id", "n").agg(q.alias("s")).select("series_id", "n", (F.col("n") * (F.col("n") + 2) * F.col("s")).alias("q"))


def leverage(returns: DataFrame) -> DataFrame:
    """Correlation of a return with the next day's squared return."""
    nxt = F.lead("ret").over(Window.partitionBy("series_id").orderBy("t"))
    return returns.select("series_id", "ret", (nxt * nxt).alias("sq")).groupBy("series_id").agg(F.corr("ret", "sq").alias("corr"))


def _regression(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    cov = np.linalg.pinv(x.T @ x) * (e @ e / max(1, len(y) - x.shape[1]))
    return beta, np.sqrt(np.diag(cov)), 1 - e @ e / max(1e-300, ((y - y.mean()) ** 2).sum())


def arch_lm(returns: DataFrame, lags: int = 10) -> DataFrame:
    """n R-squared of squared returns on their own lags; a series a group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("t")["ret"].to_numpy() ** 2
        n = len(s) - lags
        lm = np.nan
        if n > lags + 1:
            x = np.column_stack([np.ones(n), *(s[lags - k: len(s) - k] for k in range(1, lags + 1))])
            lm = n * _regression(s[lags:], x)[2]
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "n": [max(0, n)], "lm": [lm]})

    return returns.select("series_id", "t", "ret").groupBy("series_id").applyInPandas(one, "series_id string, n long, lm double")


def adf(returns: DataFrame, value: str = "ret", most_lags: int | None = None) -> DataFrame:
    """The unit-root t statistic with a constant, lags by least AIC up to
    12 (n / 100) ** 0.25 or the number given."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("t")[value].to_numpy()
        d = np.diff(v)
        most = most_lags if most_lags is not None else int(12 * (len(v) / 100) ** 0.25)
        best = None
        for lag in range(most + 1):
            y = d[most:]
            if len(y) < lag + 10:
                break
            x = np.column_stack([v[most:-1], np.ones(len(y)), *(d[most - k: len(d) - k] for k in range(1, lag + 1))])
            b, se, _ = _regression(y, x)
            e = y - x @ b
            aic = len(y) * np.log(e @ e / len(y)) + 2 * x.shape[1]
            if best is None or aic < best[0]:
                best = (aic, lag, b[0] / se[0])
        return pd.DataFrame({"series_id": [pdf["series_id"].iloc[0]], "lags": [best[1] if best else -1], "adf": [best[2] if best else np.nan]})

    got = returns.select("series_id", "t", value).groupBy("series_id").applyInPandas(one, "series_id string, lags int, adf double")
    return got.select("*", *(F.lit(c).alias(f"critical_{int(100 * a)}pct") for a, c in ADF_CRITICAL.items()))
