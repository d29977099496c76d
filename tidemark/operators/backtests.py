"""Backtests of forecasts in long form: one row a (series, model, alpha)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import stats
from ..functions.stats import CHI2_95, chi2_tail, log_or_floor
from . import scans

KEY = ("series_id", "model", "alpha")


def hits(forecasts: DataFrame) -> DataFrame:
    """Forecast rows with both figures, plus hit (1: the loss exceeds VaR)."""
    f = forecasts.where("actual_return is not null and var is not null and not isnan(actual_return) and not isnan(var)")
    return f.withColumn("hit", (F.col("actual_return") < -F.col("var")).cast("int"))


def counts(forecasts: DataFrame, width: int = scans.WIDTH) -> DataFrame:
    """Observations, violations, the four transitions between neighbouring rows
    (gaps are bridged), and the sums of the shortfall statistic.

    Rows without both figures have no hit and count nowhere, but keep their
    group. Rows are counted in buckets of width days, each of which hands its
    first and last hit on; a transition across buckets is counted between the
    hits that meet when a group's buckets, one row each, are laid side by side.
    A frame without es has no shortfall figures.
    """
    usable = F.col("actual_return").isNotNull() & F.col("var").isNotNull() & ~F.isnan("actual_return") & ~F.isnan("var")
    f = forecasts if "es" in forecasts.columns else forecasts.withColumn("es", F.lit(None).cast("double"))
    f = f.select(*KEY, "t", "actual_return", "es", F.when(usable, (F.col("actual_return") < -F.col("var")).cast("int")).alias("hit"), F.floor(F.col("t") / width).alias("_b"))
    w = Window.partitionBy(*KEY, "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    h = f.withColumn("before", F.last("hit", ignorenulls=True).over(w))
    step = lambda a, b: F.count_if((F.col("before") == a) & (F.col("hit") == b))
    es, seen = F.col("hit").isNotNull() & F.col("es").isNotNull() & ~F.isnan("es"), F.when(F.col("hit").isNotNull(), F.col("t"))
    each = h.groupBy(*KEY, "_b").agg(
        F.count("hit").alias("n_obs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_violations"),
        step(0, 0).alias("n00"), step(0, 1).alias("n01"), step(1, 0).alias("n10"), step(1, 1).alias("n11"),
        F.count_if(es).alias("n_es"), F.sum(F.when(es, F.col("actual_return") * F.col("hit"))).alias("tail_sum"), F.sum(F.when(es, F.col("es"))).alias("sum_es"),
        F.min_by("hit", seen).alias("first"), F.max_by("hit", seen).alias("last"),
    )
    ends = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("_b", "first", "last"))))
    total = each.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("n_obs", "n_violations", "n00", "n01", "n10", "n11", "n_es", "tail_sum", "sum_es")), ends.alias("a"))
    met = F.transform("a", lambda x, i: F.when(i > 0, 2 * F.get("a", i - 1)["last"] + x["first"]))
    across = lambda k: F.size(F.filter("met", lambda x: x == k))
    total = total.withColumn("met", met)
    return total.select(
        *KEY, "n_obs", F.col("n_violations").cast("long").alias("n_violations"), *((F.col(n) + across(k)).alias(n) for k, n in enumerate(("n00", "n01", "n10", "n11"))),
        "n_es", "tail_sum", F.try_divide("sum_es", "n_es").alias("mean_es"),
    )


def kupiec(c: DataFrame) -> DataFrame:
    """counts() plus the unconditional coverage test. Without observations its
    figures are null and it fails; with no or only violations the ratio is
    infinite and it fails."""
    n, t, a = F.col("n_violations"), F.col("n_obs"), F.col("alpha")
    p = F.try_divide(n, t)
    lr = F.when(t == 0, None).when((n == 0) | (n == t), F.lit(float("inf"))).otherwise(-2 * (n * F.log(a / p) + (t - n) * F.log((1 - a) / (1 - p))))
    return c.select("*", p.alias("observed_rate"), lr.alias("kupiec_lr")).select(
        "*", chi2_tail(F.col("kupiec_lr"), 1).alias("kupiec_p"), F.coalesce(F.col("kupiec_lr") <= CHI2_95[1], F.lit(False)).alias("kupiec_passed")
    )


def christoffersen(k: DataFrame) -> DataFrame:
    """kupiec() plus independence and conditional coverage."""
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p01 = F.when(n00 + n01 > 0, n01 / (n00 + n01)).otherwise(0.0)
    p11 = F.when(n10 + n11 > 0, n11 / (n10 + n11)).otherwise(0.0)
    p = F.try_divide(n01 + n11, n00 + n01 + n10 + n11)
    e = F.lit(1e-15)
    lr = -2 * (
        (n00 + n10) * log_or_floor(1 - p) + (n01 + n11) * log_or_floor(p)
        - n00 * log_or_floor(1 - p01) - n01 * log_or_floor(p01 + e) - n10 * log_or_floor(1 - p11 + e) - n11 * log_or_floor(p11 + e)
    )
    k = k.withColumn("ind_lr", F.when(F.col("n_obs") >= 2, F.greatest(lr, F.lit(0.0))))
    k = k.withColumn("cc_lr", F.when(F.col("kupiec_lr") < float("inf"), F.col("kupiec_lr") + F.col("ind_lr")))
    ok = lambda c, df: F.coalesce(F.col(c) <= CHI2_95[df], F.lit(False))
    return k.select("*", chi2_tail(F.col("ind_lr"), 1).alias("ind_p"), ok("ind_lr", 1).alias("ind_passed"), chi2_tail(F.col("cc_lr"), 2).alias("cc_p"), ok("cc_lr", 2).alias("cc_passed"))


def interpretation(z2: Column) -> Column:
    # fixed values: the published labels
    return (
        F.when(z2 < 0, "ES under-estimated (model under-forecasts tail risk)").when(z2 > 0, "ES over-estimated (model over-forecasts tail risk)")
        .when(z2 == 0, "ES exactly correct (Z2=0)").otherwise("insufficient data")
    )


def acerbi_z2(c: DataFrame) -> DataFrame:
    """counts() plus Z2; the mean ES stands in its denominator."""
    z2 = F.try_divide(F.col("tail_sum"), F.col("n_es") * F.col("alpha") * F.col("mean_es")) + 1
    return c.withColumn("as_z2", z2).withColumn("as_interpretation", interpretation(F.col("as_z2")))


def acerbi_p(forecasts: DataFrame, c: Config) -> DataFrame:
    """KEY plus as_p: the share of simulated Z2 at or below the observed one,
    for Gaussian returns of the deviation that each ES implies. The generator
    starts from the seed in every group, so partitioning does not matter."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        alpha, es, var = float(pdf["alpha"].iloc[0]), pdf["es"].to_numpy(), pdf["var"].to_numpy()
        actual, n, mean = pdf["actual_return"].to_numpy(), len(pdf), float(pdf["es"].mean())
        p = np.nan
        if n and mean:
            z2 = (actual * (actual < -var)).sum() / (n * alpha * mean) + 1
            sigma = np.clip(es / stats.tail_density(alpha), 1e-8, None)
            rng = np.random.default_rng(c.seed)
            below = 0
            for _ in range(c.simulations):
                r = rng.normal(0, sigma)
                below += (r * (r < -var)).sum() / (n * alpha * mean) + 1 <= z2
            p = below / c.simulations
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in KEY}, "as_p": [p]})

    if "es" not in forecasts.columns:
        return forecasts.select(*KEY).distinct().withColumn("as_p", F.lit(None).cast("double"))
    h = hits(forecasts).where("es is not null and not isnan(es)").select(*KEY, "t", "actual_return", "var", "es")
    return h.groupBy(*KEY).applyInPandas(one, "series_id string, model string, alpha double, as_p double")


def table(forecasts: DataFrame, c: Config, monte_carlo: bool = True) -> DataFrame:
    """All tests, figures to 4 decimals; flags come from unrounded figures."""
    got = acerbi_z2(christoffersen(kupiec(counts(forecasts))))
    r = lambda n: F.round(n, 4).alias(n)
    out = got.select(
        *KEY, "n_obs", "n_violations", r("observed_rate"), F.col("alpha").alias("expected_rate"), r("kupiec_lr"), r("kupiec_p"), "kupiec_passed",
        r("cc_lr"), r("cc_p"), "cc_passed", r("ind_lr"), r("ind_p"), "ind_passed", r("as_z2"), "as_interpretation",
    )
    if not monte_carlo:
        return out
    p = acerbi_p(forecasts, c)
    return out.join(p, list(KEY), "left").select(
        *(x for x in out.columns if x != "as_interpretation"), F.round("as_p", 4).alias("as_p"),
        F.coalesce(F.col("as_p") >= c.significance, F.lit(False)).alias("as_passed"), "as_interpretation",
    )


def missing_forecasts(forecasts: DataFrame) -> DataFrame:
    """How many rows lack a VaR, by group: the warning of a compilation."""
    return forecasts.groupBy(*KEY).agg(F.count_if(F.col("var").isNull() | F.isnan("var")).alias("n_missing")).where("n_missing > 0")
