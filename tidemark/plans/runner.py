"""The full production run: returns, forecasts of every model that are still
missing, backtests, and result tables."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FLAGGED_DATES, Config
from ..operators import backtests, garch, report, returns, rolling, sv
from ..sources import prices, store

log = logging.getLogger("tidemark")
MODELS = ("HistSim", "OU", "GARCH", "EGARCH", *sv.VARIANTS)


def forecast(model: str, r: DataFrame, c: Config, sampler: sv.Sampler = sv.Sampler(), orders: tuple[int, int, int] = (1, 1, 0), parts: DataFrame | None = None) -> DataFrame:
    """orders: p, q and o of the GARCH models. parts: the blocks (series_id,
    block) of a model that is refitted each day that are made."""
    if model == "HistSim":
        out = rolling.historical_simulation(r, c, parts)
    elif model == "OU":
        out = rolling.ou_forecasts(rolling.ou_fits(r, c, parts), c)
    elif model in ("GARCH", "EGARCH"):
        out = garch.forecasts(r, c, model, *orders, parts=parts)
    elif model in sv.VARIANTS:
        out = sv.forecasts(r, model, c, sampler)
    else:
        raise ValueError(f"unknown model {model!r}")
    return out.select(*rolling.FORECAST)


def _complete(kept: store.ForecastStore, r: DataFrame, model: str, c: Config, sampler: sv.Sampler) -> int:
    """Makes and saves what model lacks, part by part; the number of saves.

    Models that are refitted each day lack blocks of days; all open ones are one
    job. Sampled models go on from the day that each series' next fit is due, for
    about c.save_every days at a time, so a crash loses no more than that; each of
    these steps runs all series that are behind at once.
    """
    if model in sv.VARIANTS:
        return _complete_sampled(kept, r, model, c, sampler)
    part = F.floor((F.col("t") - c.window - 1) / rolling.block_days(model, c)).cast("int")
    parts = store.staged(kept.open_parts(model, r.where(F.col("t") > c.window).select("series_id", part.alias("part"), "t")), "open")
    if parts.isEmpty():
        return 0
    made = forecast(model, r.join(parts.select("series_id").distinct(), "series_id", "left_semi"), c, sampler, parts=parts.select("series_id", F.col("part").alias("block")))
    kept.save(made.withColumn("part", part), parts.select(F.lit(model).alias("model"), "series_id", "part", "days", F.lit(None).cast("int").alias("due")))
    return 1


def _complete_sampled(kept: store.ForecastStore, r: DataFrame, model: str, c: Config, sampler: sv.Sampler) -> int:
    """A part begins with the day its first fit was due. It is whole if it goes
    up to the next due day; one that ended with the series is made again when
    there are more days."""
    each, last, saves = max(1, -(-c.save_every // c.refit_every)), store.staged(r.groupBy("series_id").agg(F.max("t").alias("last")), "ends"), 0
    while True:
        state = kept.entered().where(F.col("model") == model).groupBy("series_id").agg(F.max_by(F.struct("part", "days", "due"), "part").alias("x")).select("series_id", "x.*")
        whole = F.col("days") >= F.col("due") - F.col("part")
        at = F.when(F.col("part").isNull(), c.window + 1).when(whole, F.col("due")).when(F.col("part") + F.col("days") > F.col("last"), None).otherwise(F.col("part"))
        due = store.staged(last.join(state, "series_id", "left").select("series_id", at.cast("int").alias("due"), "last").where("due <= last"), "due")
        if due.isEmpty():
            return saves
        behind = r.join(due.select("series_id"), "series_id", "left_semi")
        spans = sv.refits(behind, model, c, sampler, due, each)
        made = sv.served(behind, spans, model, c).select(*rolling.FORECAST).join(due.select("series_id", F.col("due").alias("part")), "series_id")
        entries = sv.next_due(spans, c).join(due.select("series_id", F.col("due").alias("part"), "last"), "series_id")
        days = F.least(F.col("due") - 1, F.col("last")) - F.col("part") + 1
        kept.save(made, entries.select(F.lit(model).alias("model"), "series_id", "part", days.cast("long").alias("days"), "due"))
        saves += 1


def run(bars: DataFrame, path: str, models: tuple[str, ...] = MODELS, c: Config = Config(), mask_zero_volume: bool = False, sampler: sv.Sampler = sv.Sampler()) -> DataFrame:
    """Forecasts to path/forecasts and tables to path/results; returns the table
    of backtests. What is there is not computed again. A model that fails is
    logged and the others go on; after the tables are written, the failures are
    raised together."""
    p = prices.prices(bars, mask_zero_volume=mask_zero_volume)
    r = returns.log_returns(p)
    kept = store.ForecastStore(bars.sparkSession, f"{path}/forecasts")
    failed: dict[str, Exception] = {}
    for model in models:
        try:
            log.info("%s: %d jobs", model, _complete(kept, r, model, c, sampler))
        except Exception as e:
            log.exception("%s failed", model)
            failed[model] = e
    made = kept.load()
    if made is None:
        raise RuntimeError("no model made a forecast") from next(iter(failed.values()), None)
    for x in backtests.missing_forecasts(made).groupBy("model").agg(F.sum("n_missing").alias("n")).orderBy("model").collect():
        log.warning("%s: %d rows without a forecast", x.model, x.n)
    table = backtests.table(made, c)
    store.write_csv(table, f"{path}/results/full_backtest_results")
    store.write_csv(report.pass_summary(table), f"{path}/results/summary_pass_counts")
    if failed:
        raise RuntimeError(f"failed: {', '.join(failed)}; the others' results are written") from next(iter(failed.values()))
    return table


def robustness(
    bars: DataFrame, c: Config = Config(), windows: tuple[int, ...] = (750, 1000, 1250), models: tuple[str, ...] = MODELS, leave_out: tuple[str, ...] = FLAGGED_DATES,
    orders: tuple[tuple[int, int, int], ...] = ((1, 1, 0), (2, 1, 0), (1, 2, 0), (1, 1, 1)), others: dict[str, DataFrame] | None = None, sampler: sv.Sampler = sv.Sampler(),
) -> DataFrame:
    """Backtests by arm: each window length, with flagged days and without; the
    orders of the GARCH models; wider priors of the sampled ones; and other
    bars for the same series, by name."""
    parts = []

    def add(arm: str, r: DataFrame, cw: Config, model: str, **how) -> None:
        t = backtests.table(forecast(model, r, cw, **{"sampler": sampler, **how}), cw, monte_carlo=False)
        parts.append(t.select(F.lit(arm).alias("arm"), F.lit(cw.window).alias("window"), "*"))

    r = returns.log_returns(prices.prices(bars))
    for w in windows:
        for m in models:
            add("as is", r, replace(c, window=w), m)
            if leave_out:
                add("without flagged days", returns.without(r, leave_out), replace(c, window=w), m)
    for m in models:
        if m in ("GARCH", "EGARCH"):
            for o in orders:
                add("orders " + ",".join(map(str, o)), r, c, m, orders=o)
        if m in sv.VARIANTS:
            add("flat priors", r, c, m, sampler=replace(sampler, priors=sv.FLAT))
        for name, b in (others or {}).items():
            add(name, returns.log_returns(prices.prices(b)), c, m)
    return report.compiled(*parts)


def log_to(path: str) -> None:
    """The run's log to the console and to a file of the driver, named by the time."""
    handlers = [logging.StreamHandler(), logging.FileHandler(f"{path}/run_{time.strftime('%Y%m%d_%H%M%S')}.log")]
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("sf_dir")
    a.add_argument("out")
    a.add_argument("--models", nargs="+", default=list(MODELS), choices=MODELS)
    a.add_argument("--window", type=int, default=1000)
    a.add_argument("--draws", type=int, default=500)
    a.add_argument("--logs", default=".", help="folder of the driver for the log file")
    o = a.parse_args(args)
    log_to(o.logs)
    spark = SparkSession.builder.getOrCreate()
    run(prices.order_bars(spark, o.sf_dir), o.out, tuple(o.models), Config(window=o.window), sampler=sv.Sampler(o.draws, o.draws)).show(100)


if __name__ == "__main__":
    main()
