"""Rolling one-step forecasts: quantiles and closed forms of the window before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import stats
from ..sources import store
from . import scans, sliding

FORECAST = ("series_id", "model", "date", "t", "alpha", "actual_return", "var", "es", "estimation_failed")

#: Tasks that blocks are dealt to, at most.
_MOST_TASKS = 20_000


def blocked(rows: DataFrame, before: int, first: int, block: int) -> DataFrame:
    """rows (series_id, t, ...) plus block and target: blocks of `block`
    consecutive t from first on, each with the `before` rows that precede it
    (target false). A long series thus becomes many groups; a row is in at most
    before / block + 2 of them."""
    t = F.col("t")
    low = F.greatest(F.lit(0), F.floor((t - first) / block))
    high = F.greatest(F.lit(0), F.floor((t + before - first) / block))
    spread = rows.withColumn("block", F.explode(F.sequence(low, high)))
    start = F.lit(first) + F.col("block") * block
    spread = spread.where((t >= start - before) & (t < start + block)).withColumn("target", t >= start)
    # a block after the last has history alone
    return spread.withColumn("_any", F.max("target").over(Window.partitionBy("series_id", "block"))).where("_any").drop("_any")


def only_in(blocks: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The blocks that parts (series_id, block) names; all where there is none."""
    return blocks if parts is None else blocks.join(parts.select("series_id", "block"), ["series_id", "block"], "left_semi")


def dealt(blocks: DataFrame) -> GroupedData:
    """blocked rows, written, grouped by block. Each block is a task of its own,
    however many there are (from _MOST_TASKS on, tasks have equal numbers of
    them): rows are few and fits long, so a fixed number of tasks would grow with
    the series, and hashing deals blocks unevenly. Blocks are numbered on from
    series to series, for which only a row a series meets in one task."""
    b = store.staged(blocks, "blocks")
    ends = b.groupBy("series_id").agg((F.max("block") + 1).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("series_id").rowsBetween(Window.unboundedPreceding, -1))
    ends = store.staged(ends.select("series_id", "_n", F.coalesce(before, F.lit(0)).alias("_before")), "ends")
    n = ends.agg(F.sum("_n")).first()[0] or 1
    task = F.pmod(F.col("_before") + F.col("block"), F.lit(_MOST_TASKS)).cast("int")
    placed = b.join(ends.drop("_n"), "series_id").withColumn("task", task).drop("_before")
    # grouped by the task first, so that the rows stay where they are
    return placed.repartitionById(min(n, _MOST_TASKS), "task").groupBy("task", "series_id", "block")


def _per_alpha(df: DataFrame, model: str, values: dict[float, tuple[Column, Column]], failed: Column) -> DataFrame:
    """Long forecasts from a (var, es) pair of columns for each alpha."""
    each = F.array(*(F.struct(F.lit(a).alias("alpha"), v.alias("var"), e.alias("es")) for a, (v, e) in values.items()))
    return df.select("series_id", F.lit(model).alias("model"), "date", "t", F.col("ret").alias("actual_return"), failed.alias("estimation_failed"), F.inline(each)).select(*FORECAST)


def block_days(model: str, c: Config) -> int:
    """The targets of a block of a model that is refitted each day."""
    return c.block if model in ("GARCH", "EGARCH") else max(c.block, c.window)


def historical_simulation(returns: DataFrame, c: Config, parts: DataFrame | None = None) -> DataFrame:
    """VaR: minus the linearly interpolated quantile of the window before t; ES:
    minus the mean of the returns strictly below it, or the VaR if none is. A
    block's window slides in steps of its logarithm (sliding.SlidingOrder); one
    structure serves every alpha. Too short a series gives no rows. parts: the
    blocks (series_id, block) that are made."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        first = int(pdf["target"].to_numpy().argmax())
        pdf = pdf.iloc[first - c.window:]
        tails = sliding.rolling_tails(pdf["ret"].to_numpy(), c.window, c.alphas)
        rows = pdf.iloc[c.window:]
        parts = []
        for j, a in enumerate(c.alphas):
            q, mean = tails[:, j, 0], tails[:, j, 1]
            parts.append(pd.DataFrame({
                "series_id": rows["series_id"], "model": "HistSim", "date": rows["date"], "t": rows["t"], "alpha": a, "actual_return": rows["ret"],
                "var": -q, "es": -np.where(np.isnan(mean), q, mean), "estimation_failed": False,
            }))
        return pd.concat(parts, ignore_index=True)

    b = only_in(blocked(returns.select("series_id", "date", "t", "ret"), c.window, c.window + 1, block_days("HistSim", c)), parts)
    return b.groupBy("series_id", "block").applyInPandas(one, "series_id string, model string, date date, t int, alpha double, actual_return double, var double, es double, estimation_failed boolean")


def ou_fits(returns: DataFrame, c: Config, parts: DataFrame | None = None) -> DataFrame:
    """returns plus kappa, theta, sigma, log_likelihood and converged of the
    mean-reverting process of log prices over the window before t.

    The discretised likelihood is that of a Gaussian autoregression, whose
    maximum the regression of a log price on the one before gives.
    """
    pair = Window.partitionBy("series_id").orderBy("t")
    r = returns.withColumn("y", F.log("price")).withColumn("x", F.lag("y").over(pair))
    w = Window.partitionBy("series_id", "block").orderBy("t").rowsBetween(-(c.window - 1), -1)
    b = only_in(blocked(r, c.window, c.window + 1, block_days("OU", c)), parts)
    y, x, m, dt = F.col("y"), F.col("x"), c.window - 1, c.day_fraction
    f = b.select(
        "series_id", "date", "t", "price", "ret", "x", "target",
        F.regr_slope(y, x).over(w).alias("b"), F.regr_intercept(y, x).over(w).alias("a"),
        F.var_pop(y).over(w).alias("vy"), F.var_pop(x).over(w).alias("vx"),
    ).where("target").drop("target")
    kappa = (1 - F.col("b")) / dt
    variance = F.greatest(F.lit(0.0), F.col("vy") - F.col("b") * F.col("b") * F.col("vx")) / dt
    f = f.withColumn("kappa", kappa).withColumn("variance", variance)
    converged = F.coalesce((F.col("kappa") > c.kappa_least) & (F.col("variance") > 0), F.lit(False)) if m >= 29 else F.lit(False)
    return f.select(
        "series_id", "date", "t", "price", "ret", "x", "kappa", F.try_divide(F.col("a"), 1 - F.col("b")).alias("theta"), F.sqrt("variance").alias("sigma"),
        F.when(F.col("variance") > 0, F.lit(-m / 2) * (F.log(F.lit(6.283185307179586) * F.col("variance") * dt) + 1)).alias("log_likelihood"), converged.alias("converged"),
    )


def ou_forecasts(fits: DataFrame, c: Config) -> DataFrame:
    dt = c.day_fraction
    mu = F.col("kappa") * (F.col("theta") - F.col("x")) * dt
    s = F.col("sigma") * dt**0.5
    ok = F.col("converged")
    values = {a: (F.when(ok, -(mu + s * stats.z(a))), F.when(ok, -(mu - s * stats.tail_density(a)))) for a in c.alphas}
    return _per_alpha(fits, "OU", values, ~ok)


def failure_rate(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("series_id", "model", "alpha").agg(
        F.count_if("estimation_failed").alias("n_failed"), F.count(F.lit(1)).alias("n"), (F.count_if("estimation_failed") * 100.0 / F.count(F.lit(1))).alias("pct_failed")
    )


def kappa_path(fits: DataFrame, c: Config, every: int = 21) -> DataFrame:
    """Every 21st fit's kappa, null where it did not converge."""
    return fits.where((F.col("t") - c.window - 1) % every == 0).select("series_id", "date", F.when(F.col("converged"), F.col("kappa")).alias("kappa"))


def price_days(prices: DataFrame, width: int = scans.WIDTH) -> DataFrame:
    """(series_id, date, t, price, ret) of the days with a positive price, counted
    by themselves; ret is null. ou_fits() of it follows the prices' own days,
    also where a missing one has cost two returns."""
    rows = scans.bucketed(prices.where("price > 0").select("series_id", "date", "price"), "date", width)
    return scans.scanned(rows, ("series_id",), ["date"], None, t="number").select("series_id", "date", "t", "price", F.lit(None).cast("double").alias("ret"))


def refit_schedule(returns: DataFrame, c: Config) -> DataFrame:
    """The forecast days and the t of the fit that each uses."""
    t = F.col("t")
    refit = t - (t - c.window - 1) % c.refit_every
    return returns.where(t > c.window).select("series_id", "date", "t", refit.alias("refit_t"), (refit == t).alias("is_refit"))


def fixed_garch(returns: DataFrame, omega: float, alpha: float, beta: float, window: int) -> DataFrame:
    """Next-step variance (percent squared) of GARCH(1,1) with given parameters
    over the window before t, started at the window's mean square."""
    w = Window.partitionBy("series_id", "block").orderBy("t").rowsBetween(-window, -1)
    b = blocked(returns, window, window + 1, window)
    r = b.select("*", F.collect_list(F.col("ret") * 100).over(w).alias("a")).where("target")
    start = F.aggregate("a", F.lit(0.0), lambda m, x: m + x * x) / F.lit(float(window))
    v = F.aggregate("a", start, lambda v, x: F.lit(omega) + F.lit(alpha) * x * x + F.lit(beta) * v)
    return r.select("series_id", "date", "t", v.alias("variance"))


def fixed_garch_ahead(returns: DataFrame, omega: float, alpha: float, beta: float, window: int, horizon: int = 10) -> DataFrame:
    """fixed_garch() for the next `horizon` days (h from 1): what is expected of
    day h tends to the long-run variance by alpha + beta a day, or grows by omega
    a day where that is 1."""
    k, ahead = alpha + beta, F.col("h") - 1
    share = F.pow(F.lit(k), ahead)
    grown = F.lit(omega) * ahead if k == 1 else F.lit(omega / (1 - k)) * (1 - share)
    v = fixed_garch(returns, omega, alpha, beta, window).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return v.select("series_id", "date", "t", "h", (grown + share * F.col("variance")).alias("variance"))


def var_overlay(forecasts: DataFrame) -> DataFrame:
    hit = F.col("actual_return") < -F.col("var")
    return forecasts.select("series_id", "model", "date", "alpha", (F.col("actual_return") * 100).alias("ret_pct"), (-F.col("var") * 100).alias("neg_var_pct"), F.coalesce(hit, F.lit(False)).alias("is_violation"))
