"""Registered queries of the risk engine and their DuckDB counterparts.

Series come from `orders` (a series a priority, daily) unless a query says
otherwise. Figures are rounded on both sides, because engines add in different
orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import stats
from ..functions.stats import CHI2_95, ERFC
from ..operators import backtests, diagnostics, garch, report, returns, rolling, scans, sv
from ..sources import prices

SHORT = Config(window=250)
ALPHAS = SHORT.alphas
FLAGGED = ("1997-03-03", "1998-07-15", "2000-01-10")
BANDS = {"first": ("1996-01-01", "1996-03-31"), "second": ("1998-06-01", "1998-12-31"), "last": ("2001-06-01", "2030-01-01")}
SERIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
GARCH_FIXED = (0.05, 0.08, 0.9, 100)


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def _bars(spark, d):
    return prices.order_bars(spark, d)


def _prices(spark, d, masked=False):
    return prices.prices(_bars(spark, d), mask_zero_volume=masked)


def _returns(spark, d):
    return returns.log_returns(_prices(spark, d))


def _hs(spark, d, c=SHORT):
    return rolling.historical_simulation(_returns(spark, d), c)


def _fits(spark, d):
    return rolling.ou_fits(_returns(spark, d), SHORT)


def _ou(spark, d):
    return rolling.ou_forecasts(_fits(spark, d), SHORT)


def _both(spark, d):
    return _hs(spark, d).unionByName(_ou(spark, d))


def _table(spark, d):
    return backtests.table(_both(spark, d), SHORT, monte_carlo=False)


def _full(spark, d):
    """With the Monte Carlo p of the shortfall test, which no SQL can draw."""
    return backtests.table(_both(spark, d), SHORT)


def _hs_query(c):
    return lambda s, d: _rounded(_hs(s, d, c), actual_return=8, var=8, es=8)


def _fit_stats(df):
    return _rounded(df, kappa=6, theta=6, sigma=6, log_likelihood=4)


def _cross(spark, d):
    """Every series of orders against one of lineitem, in turn by name: an
    alignment of two unlike sources on common days."""
    pair = spark.createDataFrame([(s, "ANR"[k % 3]) for k, s in enumerate(SERIES)], "name string, series_id string")
    b = prices.prices(prices.lineitem_bars(spark, d)).join(F.broadcast(pair), "series_id").drop("series_id").withColumnRenamed("name", "series_id")
    return _prices(spark, d), b


def _sv(variant):
    def query(spark, d):
        return sv.forecasts(_returns(spark, d), variant, SHORT)
    return query


def _purchases_and_clicks(spark, d):
    """By user and hour, so that many meet at one time."""
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("hour"), "value", "event_type")
    return tuple(e.where(F.col("event_type") == k).drop("event_type") for k in ("purchase", "click"))


def _as_of(direction, **how):
    def query(spark, d):
        got = scans.as_of(*_purchases_and_clicks(spark, d), ("user_id",), "hour", ["event_id"], direction, width=86_400, **how)
        return got.withColumn("hour_right", F.unix_seconds(F.col("hour_right").cast("timestamp")))
    return query


def _ahead(spark, d):
    return _rounded(rolling.fixed_garch_ahead(_returns(spark, d), *GARCH_FIXED), variance=6)


QUERIES = {
    "daily_bars": _bars,
    "lineitem_bars": lambda s, d: prices.lineitem_bars(s, d),
    "event_hour_bars": lambda s, d: prices.event_bars(s, d),
    "zero_volume_mask": lambda s, d: _prices(s, d, True),
    "log_returns": lambda s, d: _rounded(_returns(s, d).drop("price"), ret=8),
    "masked_returns": lambda s, d: _rounded(returns.log_returns(_prices(s, d, True)).drop("price"), ret=8),
    "return_summary": lambda s, d: returns.summary(_returns(s, d)),
    "flagged_dates": lambda s, d: _rounded(returns.flagged(_returns(s, d), FLAGGED).drop("price"), ret=8),
    "price_ffill_align": lambda s, d: _rounded(returns.aligned(_returns(s, d), _prices(s, d, True)), ret=8, price=6),
    "hs_var_es_250": _hs_query(SHORT),
    "hs_var_es_1000": _hs_query(Config()),
    "violations": lambda s, d: _rounded(backtests.hits(_hs(s, d)).where("hit = 1").select("series_id", "date", "alpha", "actual_return", "var"), actual_return=8, var=8),
    "kupiec": lambda s, d: _rounded(backtests.kupiec(backtests.counts(_hs(s, d))).select("series_id", "alpha", "n_obs", "n_violations", "observed_rate", "kupiec_lr", "kupiec_p", "kupiec_passed"), observed_rate=8, kupiec_lr=6, kupiec_p=4),
    "hit_transitions": lambda s, d: backtests.counts(_hs(s, d)).select("series_id", "alpha", "n00", "n01", "n10", "n11"),
    "christoffersen": lambda s, d: _rounded(backtests.christoffersen(backtests.kupiec(backtests.counts(_hs(s, d)))).select("series_id", "alpha", "ind_lr", "ind_p", "ind_passed", "cc_lr", "cc_p", "cc_passed"), ind_lr=6, cc_lr=6, ind_p=4, cc_p=4),
    "acerbi_z2": lambda s, d: _rounded(backtests.acerbi_z2(backtests.counts(_hs(s, d))).select("series_id", "alpha", "as_z2", "as_interpretation"), as_z2=8),
    "acerbi_mc_p": lambda s, d: backtests.acerbi_p(_hs(s, d), SHORT),
    "ou_fit": lambda s, d: _fit_stats(_fits(s, d).select("series_id", "date", "t", "kappa", "theta", "sigma", "log_likelihood", "converged")),
    "ou_var_es": lambda s, d: _rounded(_ou(s, d), actual_return=8, var=6, es=6),
    "ou_fail_rate": lambda s, d: _rounded(rolling.failure_rate(_ou(s, d)), pct_failed=6),
    "ou_kappa_21d": lambda s, d: _rounded(rolling.kappa_path(_fits(s, d), SHORT), kappa=6),
    "ou_kappa_prices": lambda s, d: _rounded(rolling.kappa_path(rolling.ou_fits(rolling.price_days(_prices(s, d, True)), SHORT), SHORT), kappa=6),
    "backtest_table": _table,
    "pass_summary": lambda s, d: report.pass_summary(_table(s, d)),
    "backtest_table_full": lambda s, d: _full(s, d),
    "pass_summary_full": lambda s, d: report.pass_summary(_full(s, d)),
    "heatmap_pivot": lambda s, d: report.heatmap(_table(s, d)),
    "model_rank": lambda s, d: _rounded(report.ranking(_table(s, d)), mean_abs_z2=4),
    "bonferroni": lambda s, d: report.bonferroni(_table(s, d)),
    "hill_index": lambda s, d: _rounded(diagnostics.hill(_returns(s, d)), hill=6),
    "jarque_bera": lambda s, d: _rounded(diagnostics.jarque_bera(_returns(s, d)), jb=6, p=8),
    "acf_sq_40": lambda s, d: _rounded(diagnostics.acf(_returns(s, d)), acf=8),
    "ljung_box": lambda s, d: _rounded(diagnostics.ljung_box(_returns(s, d)), q=6),
    "leverage_corr": lambda s, d: _rounded(diagnostics.leverage(_returns(s, d)), corr=8),
    "five_sigma": lambda s, d: _rounded(returns.five_sigma(_returns(s, d)).select("series_id", "date", "ret"), ret=8),
    "large_moves": lambda s, d: _rounded(returns.five_sigma(_returns(s, d), 2.5).select("series_id", "date", "ret"), ret=8),
    "last_100": lambda s, d: _rounded(returns.tail(_returns(s, d), 100).drop("price"), ret=8),
    "cross_validate": lambda s, d: _rounded(returns.cross_validated(*_cross(s, d)), corr=8, mean_abs_diff=8),
    "lag_shift_check": lambda s, d: _rounded(returns.shifted(*_cross(s, d)), corr=8, mean_abs_diff=8),
    "zero_volume_diag": lambda s, d: _rounded(returns.zero_volume_moves(_bars(s, d), 0.5), zero_share=8, after_zero=8, base_rate=8),
    "crisis_bands": lambda s, d: _rounded(returns.in_bands(_returns(s, d), BANDS), ret_pct=6),
    "var_overlay": lambda s, d: _rounded(rolling.var_overlay(_hs(s, d)), ret_pct=6, neg_var_pct=6),
    "return_histogram": lambda s, d: _rounded(report.histogram(_returns(s, d), "ret", ["series_id"]), centre=8, density=6, normal_density=6, median=8),
    "refit_schedule": lambda s, d: rolling.refit_schedule(_returns(s, d), Config(window=250)),
    "garch_filter_fixed": lambda s, d: _rounded(rolling.fixed_garch(_returns(s, d), *GARCH_FIXED), variance=6),
    "garch_horizon_fixed": _ahead,
    "as_of_backward": _as_of("backward"),
    "as_of_forward": _as_of("forward", tolerance=6 * 3600, exact=False),
    "as_of_nearest": _as_of("nearest", tolerance=86_400),
    "garch_horizon": lambda s, d: garch.horizon_forecasts(_returns(s, d), SHORT, "GARCH"),
    "egarch_horizon": lambda s, d: garch.horizon_forecasts(_returns(s, d), SHORT, "EGARCH"),
    "garch_orders": lambda s, d: garch.compared(_returns(s, d), SHORT),
    "garch_fit": lambda s, d: garch.forecasts(_returns(s, d), SHORT, "GARCH", with_fit=True),
    "egarch_fit": lambda s, d: garch.forecasts(_returns(s, d), SHORT, "EGARCH", with_fit=True),
    "arch_lm": lambda s, d: _rounded(diagnostics.arch_lm(_returns(s, d)), lm=6),
    "adf": lambda s, d: _rounded(diagnostics.adf(_returns(s, d)), adf=6),
    "sv_gaussian": _sv("SV-Gaussian"),
    "sv_t": _sv("SV-t"),
    "sv_leverage": _sv("SV-Leverage"),
    "sv_t_leverage": _sv("SV-t-Leverage"),
    "sv_posterior_histogram": lambda s, d: report.histogram(
        sv.long_draws(sv.posterior(_returns(s, d), "SV-t", SHORT), ("phi", "sigma", "nu")), "value", ["series_id", "variant", "refit_t", "parameter"]),
}


# ---- the same in DuckDB -------------------------------------------------------

_BARS_SQL = """bars AS (SELECT o_orderpriority series_id, CAST(o_orderdate AS DATE) date, round(avg(o_totalprice), 6) AS "close",
  count(*) FILTER (WHERE o_orderstatus = 'F') AS volume FROM orders GROUP BY 1, 2)"""


def _ret_sql(price: str, name: str = "ret") -> str:
    return f"""{name}0 AS (SELECT series_id, date, {price} AS price, lag({price}) OVER (PARTITION BY series_id ORDER BY date) AS before FROM bars),
{name} AS (SELECT series_id, date, CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS t, price, ln(price / before) AS ret
  FROM {name}0 WHERE price > 0 AND before > 0)"""


_RET_SQL = _BARS_SQL + ",\n" + _ret_sql('"close"')
_MASKED = 'CASE WHEN volume = 0 THEN NULL ELSE "close" END'
_ALPHAS_SQL = "alphas AS (SELECT unnest([" + ", ".join(map(str, ALPHAS)) + "]::DOUBLE[]) AS alpha)"


def _hs_sql(window: int) -> str:
    cases = " ".join(f"WHEN alpha = {a} THEN quantile_cont(ret, {a}) OVER w" for a in ALPHAS)
    return f"""{_RET_SQL}, {_ALPHAS_SQL},
hs0 AS (SELECT series_id, date, t, alpha, ret AS actual_return, CASE {cases} END AS q, list(ret) OVER w AS a
  FROM ret, alphas WINDOW w AS (PARTITION BY series_id, alpha ORDER BY t ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)),
hs AS (SELECT series_id, 'HistSim' AS model, date, t, alpha, actual_return, -q AS var,
  coalesce(-list_avg(list_filter(a, lambda x: x < q)), -q) AS es, false AS estimation_failed FROM hs0 WHERE t > {window})"""


_HS_SQL = _hs_sql(250)
_DT = SHORT.day_fraction
_M = SHORT.window - 1
_OU_FITS_SQL = f"""xy AS (SELECT series_id, date, t, price, ret, ln(price) AS y, ln(lag(price) OVER (PARTITION BY series_id ORDER BY t)) AS x FROM ret),
reg AS (SELECT *, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, var_pop(y) OVER w AS vy, var_pop(x) OVER w AS vx
  FROM xy WINDOW w AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {_M} PRECEDING AND 1 PRECEDING)),
fits AS (SELECT series_id, date, t, price, ret, x, (1 - b) / {_DT!r} AS kappa, a / (1 - b) AS theta, sqrt(greatest(0.0, vy - b * b * vx) / {_DT!r}) AS sigma,
  CASE WHEN vy - b * b * vx > 0 THEN -{_M / 2} * (ln(6.283185307179586 * greatest(0.0, vy - b * b * vx)) + 1) END AS log_likelihood,
  coalesce((1 - b) / {_DT!r} > 0.01 AND vy - b * b * vx > 0, false) AS converged FROM reg WHERE t > {SHORT.window})"""


def _by_alpha(f) -> str:
    return "CASE " + " ".join(f"WHEN alpha = {a} THEN {f(a)}" for a in ALPHAS) + " END"


_OU_SQL = f"""{_OU_FITS_SQL},
ou AS (SELECT series_id, 'OU' AS model, date, t, alpha, ret AS actual_return,
  CASE WHEN converged THEN -(kappa * (theta - x) * {_DT!r} + sigma * {_DT**0.5!r} * {_by_alpha(lambda a: repr(stats.z(a)))}) END AS var,
  CASE WHEN converged THEN -(kappa * (theta - x) * {_DT!r} - sigma * {_DT**0.5!r} * {_by_alpha(lambda a: repr(stats.tail_density(a)))}) END AS es,
  NOT converged AS estimation_failed FROM fits, alphas)"""

_poly = "0.0"
for _c in reversed(ERFC):
    _poly = f"({_poly} * tt + {_c!r})"


def _tail1(lr: str) -> str:
    v = f"sqrt({lr} / 2)"
    tt = f"(1 / (1 + 0.5 * {v}))"
    return f"CASE WHEN isinf({lr}) THEN 0.0 ELSE {tt} * exp(-{v} * {v} + {_poly.replace('tt', tt)}) END"


_SAFE = "(CASE WHEN {0} > 0 THEN ln({0}) ELSE -1e10 END)"


def _tests_sql(source: str) -> str:
    ln = _SAFE.format
    return f"""hit AS (SELECT *, CAST(actual_return < -var AS INTEGER) AS hit, lag(CAST(actual_return < -var AS INTEGER)) OVER (PARTITION BY series_id, model, alpha ORDER BY t) AS before
  FROM {source} WHERE actual_return IS NOT NULL AND var IS NOT NULL),
cnt0 AS (SELECT series_id, model, alpha, count(*) AS n_obs, sum(hit) AS n_violations, count(*) FILTER (WHERE before = 0 AND hit = 0) AS n00,
  count(*) FILTER (WHERE before = 0 AND hit = 1) AS n01, count(*) FILTER (WHERE before = 1 AND hit = 0) AS n10, count(*) FILTER (WHERE before = 1 AND hit = 1) AS n11,
  count(es) AS n_es, sum(actual_return * hit) FILTER (WHERE es IS NOT NULL) AS tail_sum, avg(es) AS mean_es FROM hit GROUP BY 1, 2, 3),
cnt AS (SELECT series_id, model, alpha, coalesce(n_obs, 0) AS n_obs, CAST(coalesce(n_violations, 0) AS BIGINT) AS n_violations, coalesce(n00, 0) AS n00, coalesce(n01, 0) AS n01,
  coalesce(n10, 0) AS n10, coalesce(n11, 0) AS n11, coalesce(n_es, 0) AS n_es, tail_sum, mean_es FROM (SELECT DISTINCT series_id, model, alpha FROM {source}) LEFT JOIN cnt0 USING (series_id, model, alpha)),
lrs AS (SELECT *, CASE WHEN n_obs > 0 THEN n_violations / n_obs END AS observed_rate,
  CASE WHEN n_obs = 0 THEN NULL WHEN n_violations = 0 OR n_violations = n_obs THEN CAST('Infinity' AS DOUBLE)
    ELSE -2 * (n_violations * ln(alpha * n_obs / n_violations) + (n_obs - n_violations) * ln((1 - alpha) / (1 - n_violations / n_obs))) END AS kupiec_lr,
  CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0.0 END AS p01, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0.0 END AS p11,
  CASE WHEN n00 + n01 + n10 + n11 > 0 THEN (n01 + n11) / (n00 + n01 + n10 + n11) END AS pp FROM cnt),
ind AS (SELECT *, CASE WHEN n_obs >= 2 THEN greatest(0.0, -2 * ((n00 + n10) * {ln('(1 - pp)')} + (n01 + n11) * {ln('pp')} - n00 * {ln('(1 - p01)')}
  - n01 * {ln('(p01 + 1e-15)')} - n10 * {ln('(1 - p11 + 1e-15)')} - n11 * {ln('(p11 + 1e-15)')})) END AS ind_lr FROM lrs),
tests AS (SELECT *, CASE WHEN NOT isinf(kupiec_lr) THEN kupiec_lr + ind_lr END AS cc_lr, tail_sum / (n_es * alpha * mean_es) + 1 AS as_z2 FROM ind),
res AS (SELECT series_id, model, alpha, n_obs, n_violations, observed_rate, kupiec_lr, {_tail1('kupiec_lr')} AS kupiec_p, coalesce(kupiec_lr <= {CHI2_95[1]!r}, false) AS kupiec_passed,
  cc_lr, exp(-cc_lr / 2) AS cc_p, coalesce(cc_lr <= {CHI2_95[2]!r}, false) AS cc_passed, ind_lr, {_tail1('ind_lr')} AS ind_p, coalesce(ind_lr <= {CHI2_95[1]!r}, false) AS ind_passed,
  as_z2, CASE WHEN as_z2 < 0 THEN 'ES under-estimated (model under-forecasts tail risk)' WHEN as_z2 > 0 THEN 'ES over-estimated (model over-forecasts tail risk)'
    WHEN as_z2 = 0 THEN 'ES exactly correct (Z2=0)' ELSE 'insufficient data' END AS as_interpretation, n00, n01, n10, n11 FROM tests)"""


_HS_TESTS = f"WITH {_HS_SQL}, {_tests_sql('hs')}"
_TABLE_SQL = f"""WITH {_HS_SQL}, {_OU_SQL}, fc AS (SELECT * FROM hs UNION ALL SELECT * FROM ou), {_tests_sql('fc')},
tab AS (SELECT series_id, model, alpha, n_obs, n_violations, round(observed_rate, 4) AS observed_rate, alpha AS expected_rate, round(kupiec_lr, 4) AS kupiec_lr, round(kupiec_p, 4) AS kupiec_p, kupiec_passed,
  round(cc_lr, 4) AS cc_lr, round(cc_p, 4) AS cc_p, cc_passed, round(ind_lr, 4) AS ind_lr, round(ind_p, 4) AS ind_p, ind_passed, round(as_z2, 4) AS as_z2, as_interpretation FROM res)"""
_PASSES = ", ".join(f"CAST(sum(CAST({t}_passed AS INTEGER)) AS BIGINT) AS {t}_pass" for t in ("kupiec", "cc", "ind"))
_CROSS_SQL = f"""WITH {_BARS_SQL}, a AS (SELECT series_id, date, "close" AS a FROM bars), pair(series_id, flag) AS (VALUES {', '.join(f"('{s}', '{'ANR'[k % 3]}')" for k, s in enumerate(SERIES))}),
b0 AS (SELECT series_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice), 6) AS b FROM lineitem JOIN pair ON flag = l_returnflag GROUP BY 1, 2)"""
_W = "OVER (PARTITION BY series_id ORDER BY date)"
_CELLS = ", ".join(
    f"""max(CAST({t}_passed AS INTEGER)) FILTER (WHERE series_id = '{s}' AND alpha = {a}) AS "{s}|{a}|{t}\"""" for s in SERIES for a in ALPHAS for t in ("kupiec", "cc", "ind")
)


#: swept: a regression's columns x (regressors, then the target) about their
#: means, swept one by one; at step k the matrix a (of m rows, in one list) is
#: that of the regression on the first k.
_SWEPT_SQL = """g AS (SELECT series_id, len(x) AS m, i, j, count(*) AS n, covar_pop(x[i], x[j]) * count(*) AS g
  FROM x, range(1, 60) AS u(i), range(1, 60) AS v(j) WHERE i <= len(x) AND j <= len(x) GROUP BY ALL),
swept AS (SELECT series_id, n, m, 0 AS k, list(g ORDER BY i, j) AS a FROM g GROUP BY series_id, n, m
  UNION ALL SELECT series_id, n, m, k + 1, list_transform(range(m * m), lambda q: CASE
    WHEN q = k * m + k THEN 1 / a[k * m + k + 1]
    WHEN q // m = k THEN a[q + 1] / a[k * m + k + 1]
    WHEN q % m = k THEN -a[q + 1] / a[k * m + k + 1]
    ELSE a[q + 1] - a[q // m * m + k + 1] * a[k * m + q % m + 1] / a[k * m + k + 1] END) FROM swept WHERE k < m - 1)"""


def _acf_sql(lags: int, x: str) -> str:
    sums = ", ".join(f"sum(d * d{k}) / sum(d * d) AS c{k}" for k in range(1, lags + 1))
    lagged = ", ".join(f"lag(d, {k}) OVER (PARTITION BY series_id ORDER BY t) AS d{k}" for k in range(1, lags + 1))
    rows = " UNION ALL ".join(f"SELECT series_id, {k} AS lag, c{k} AS acf FROM s" for k in range(1, lags + 1))
    return f"""WITH {_RET_SQL}, d AS (SELECT series_id, t, {x} - avg({x}) OVER (PARTITION BY series_id) AS d FROM ret), l AS (SELECT series_id, d, {lagged} FROM d),
s AS (SELECT series_id, {sums} FROM l GROUP BY 1), acf AS ({rows})"""


_EVENTS_SQL = """WITH e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hour, value, event_type FROM events), l AS (SELECT event_id, user_id, hour, value FROM e WHERE event_type = 'purchase'),
back AS (SELECT user_id, hour, max(event_id) AS event_id_right, arg_max(value, event_id) AS value_right FROM e WHERE event_type = 'click' GROUP BY 1, 2),
ahead AS (SELECT user_id, hour, min(event_id) AS event_id_right, arg_min(value, event_id) AS value_right FROM e WHERE event_type = 'click' GROUP BY 1, 2)"""
_SIGMA_SQL = f"""WITH {_RET_SQL}, z AS (SELECT *, avg(ret) OVER (PARTITION BY series_id) AS m, stddev_samp(ret) OVER (PARTITION BY series_id) AS s FROM ret)
  SELECT series_id, date, round(ret, 8) AS ret FROM z WHERE abs(ret - m) > {{}} * s"""
_OMEGA, _A1, _B1, _GW = GARCH_FIXED

ORACLE_SQL = {
    "daily_bars": f"WITH {_BARS_SQL} SELECT * FROM bars",
    "lineitem_bars": """SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice), 6) AS "close", max(l_extendedprice) AS high, min(l_extendedprice) AS low, count(*) AS volume FROM lineitem GROUP BY 1, 2""",
    "event_hour_bars": """SELECT event_type AS series_id, date_trunc('hour', ts) AS hour, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS "close", count(*) AS volume FROM events GROUP BY 1, 2""",
    "zero_volume_mask": f"WITH {_BARS_SQL} SELECT series_id, date, {_MASKED} AS price FROM bars",
    "log_returns": f"WITH {_RET_SQL} SELECT series_id, date, t, round(ret, 8) AS ret FROM ret",
    "masked_returns": f"WITH {_BARS_SQL}, {_ret_sql(_MASKED)} SELECT series_id, date, t, round(ret, 8) AS ret FROM ret",
    "return_summary": f"""WITH {_RET_SQL} SELECT series_id, count(ret) AS n_obs, min(date) AS start, max(date) AS "end", round(avg(ret), 6) AS mean, round(stddev_samp(ret) * sqrt(252.0), 4) AS ann_vol,
  round(skewness(ret), 4) AS skewness, round(kurtosis(ret), 4) AS excess_kurtosis FROM ret GROUP BY 1""",
    "flagged_dates": f"WITH {_RET_SQL} SELECT series_id, date, t, round(ret, 8) AS ret FROM ret WHERE date IN ({', '.join(f'DATE {chr(39)}{x}{chr(39)}' for x in FLAGGED)})",
    "price_ffill_align": f"""WITH {_RET_SQL}, m AS (SELECT series_id, date, {_MASKED} AS p FROM bars)
  SELECT series_id, date, t, round(ret, 8) AS ret, round(last_value(p IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS price FROM ret LEFT JOIN m USING (series_id, date)""",
    "hs_var_es_250": f"WITH {_HS_SQL} SELECT * REPLACE (round(actual_return, 8) AS actual_return, round(var, 8) AS var, round(es, 8) AS es) FROM hs",
    "hs_var_es_1000": f"WITH {_hs_sql(1000)} SELECT * REPLACE (round(actual_return, 8) AS actual_return, round(var, 8) AS var, round(es, 8) AS es) FROM hs",
    "violations": f"WITH {_HS_SQL} SELECT series_id, date, alpha, round(actual_return, 8) AS actual_return, round(var, 8) AS var FROM hs WHERE actual_return < -var",
    "kupiec": f"{_HS_TESTS} SELECT series_id, alpha, n_obs, n_violations, round(observed_rate, 8) AS observed_rate, round(kupiec_lr, 6) AS kupiec_lr, round(kupiec_p, 4) AS kupiec_p, kupiec_passed FROM res",
    "hit_transitions": f"{_HS_TESTS} SELECT series_id, alpha, n00, n01, n10, n11 FROM res",
    "christoffersen": f"{_HS_TESTS} SELECT series_id, alpha, round(ind_lr, 6) AS ind_lr, round(ind_p, 4) AS ind_p, ind_passed, round(cc_lr, 6) AS cc_lr, round(cc_p, 4) AS cc_p, cc_passed FROM res",
    "acerbi_z2": f"{_HS_TESTS} SELECT series_id, alpha, round(as_z2, 8) AS as_z2, as_interpretation FROM res",
    "ou_fit": f"WITH {_RET_SQL}, {_OU_FITS_SQL} SELECT series_id, date, t, round(kappa, 6) AS kappa, round(theta, 6) AS theta, round(sigma, 6) AS sigma, round(log_likelihood, 4) AS log_likelihood, converged FROM fits",
    "ou_var_es": f"WITH {_RET_SQL}, {_ALPHAS_SQL}, {_OU_SQL} SELECT * REPLACE (round(actual_return, 8) AS actual_return, round(var, 6) AS var, round(es, 6) AS es) FROM ou",
    "ou_fail_rate": f"""WITH {_RET_SQL}, {_ALPHAS_SQL}, {_OU_SQL} SELECT series_id, model, alpha, count(*) FILTER (WHERE estimation_failed) AS n_failed, count(*) AS n,
  round(count(*) FILTER (WHERE estimation_failed) * 100.0 / count(*), 6) AS pct_failed FROM ou GROUP BY 1, 2, 3""",
    "ou_kappa_21d": f"WITH {_RET_SQL}, {_OU_FITS_SQL} SELECT series_id, date, round(CASE WHEN converged THEN kappa END, 6) AS kappa FROM fits WHERE (t - {SHORT.window + 1}) % 21 = 0",
    "ou_kappa_prices": f"""WITH {_BARS_SQL}, ret AS (SELECT series_id, date, row_number() OVER (PARTITION BY series_id ORDER BY date) AS t, {_MASKED} AS price, NULL AS ret FROM bars WHERE {_MASKED} > 0),
{_OU_FITS_SQL} SELECT series_id, date, round(CASE WHEN converged THEN kappa END, 6) AS kappa FROM fits WHERE (t - {SHORT.window + 1}) % 21 = 0""",
    "backtest_table": f"{_TABLE_SQL} SELECT * FROM tab",
    "pass_summary": f"{_TABLE_SQL} SELECT series_id, model, {_PASSES}, count(alpha) * 3 AS total_tests FROM tab GROUP BY 1, 2",
    "heatmap_pivot": f"{_TABLE_SQL} SELECT model, {_CELLS} FROM tab GROUP BY 1",
    "model_rank": f"""{_TABLE_SQL}, s AS (SELECT model, CAST(sum(CAST(kupiec_passed AS INTEGER) + CAST(cc_passed AS INTEGER) + CAST(ind_passed AS INTEGER)) AS BIGINT) AS passes, round(avg(abs(as_z2)), 6) AS z FROM tab GROUP BY 1)
  SELECT model, passes, round(z, 4) AS mean_abs_z2, CAST(rank() OVER (ORDER BY passes DESC, z) AS INTEGER) AS rank FROM s""",
    "bonferroni": f"{_TABLE_SQL} SELECT series_id, model, alpha, test, p, coalesce(p >= 0.05 / 48, false) AS passed_corrected FROM (" + " UNION ALL ".join(f"SELECT series_id, model, alpha, '{t}' AS test, {t}_p AS p FROM tab" for t in ("kupiec", "cc", "ind")) + ")",
    "hill_index": f"""WITH {_RET_SQL}, r AS (SELECT series_id, abs(ret) AS a, row_number() OVER (PARTITION BY series_id ORDER BY abs(ret) DESC, t) AS k FROM ret)
  SELECT series_id, round(CASE WHEN count(*) = 101 THEN 1 / (sum(ln(a)) FILTER (WHERE k <= 100) / 100 - max(ln(a)) FILTER (WHERE k = 101)) END, 6) AS hill FROM r WHERE k <= 101 GROUP BY 1""",
    "jarque_bera": f"""WITH {_RET_SQL}, c AS (SELECT series_id, ret - avg(ret) OVER (PARTITION BY series_id) AS d FROM ret), m AS (SELECT series_id, count(*) AS n, avg(d * d) AS m2, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM c GROUP BY 1),
  j AS (SELECT series_id, n, n / 6 * (m3 * m3 / (m2 * m2 * m2) + pow(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM m) SELECT series_id, n, round(jb, 6) AS jb, round(exp(-jb / 2), 8) AS p FROM j""",
    "acf_sq_40": _acf_sql(40, "ret * ret") + " SELECT series_id, lag, round(acf, 8) AS acf FROM acf",
    "ljung_box": _acf_sql(10, "ret") + ", n AS (SELECT series_id, count(*) AS n FROM ret GROUP BY 1) SELECT series_id, n, round(n * (n + 2) * sum(acf * acf / (n - lag)), 6) AS q FROM acf JOIN n USING (series_id) GROUP BY series_id, n",
    "arch_lm": f"""WITH RECURSIVE {_RET_SQL}, c AS (SELECT series_id, count(*) AS all_n, list(ret * ret ORDER BY t) AS l FROM ret GROUP BY 1),
x AS (SELECT series_id, list_transform([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 0], lambda k: l[t - k]) AS x FROM c JOIN ret USING (series_id) WHERE t > 10),
{_SWEPT_SQL}
SELECT series_id, greatest(0, all_n - 10) AS n, round(CASE WHEN all_n - 10 > 11 THEN z.n * (1 - z.a[121] / o.a[121]) END, 6) AS lm
FROM c LEFT JOIN swept AS o USING (series_id) LEFT JOIN swept AS z USING (series_id) WHERE coalesce(o.k, 0) = 0 AND coalesce(z.k, 10) = 10""",
    "adf": f"""WITH RECURSIVE {_RET_SQL}, c AS (SELECT series_id, CAST(floor(12 * pow(count(*) / 100, 0.25)) AS INTEGER) AS most, list(ret ORDER BY t) AS l FROM ret GROUP BY 1),
x AS (SELECT series_id, list_concat([l[t - 1]], list_transform(range(1, most + 1), lambda k: l[t - k] - l[t - k - 1]), [l[t] - l[t - 1]]) AS x FROM c JOIN ret USING (series_id) WHERE t > most + 1),
{_SWEPT_SQL}, fits AS (SELECT series_id, k - 1 AS lags, n * ln(a[m * m] / n) + 2 * (k + 1) AS aic, a[m] / sqrt(a[1] * a[m * m] / greatest(1, n - k - 1)) AS adf FROM swept WHERE k > 0 AND n >= k + 9),
best AS (SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY aic, lags) = 1)
SELECT series_id, CAST(coalesce(lags, -1) AS INTEGER) AS lags, round(adf, 6) AS adf, {', '.join(f"CAST({v} AS DOUBLE) AS critical_{int(100 * k)}pct" for k, v in diagnostics.ADF_CRITICAL.items())} FROM c LEFT JOIN best USING (series_id)""",
    "leverage_corr": f"WITH {_RET_SQL}, l AS (SELECT series_id, ret, pow(lead(ret) OVER (PARTITION BY series_id ORDER BY t), 2) AS sq FROM ret) SELECT series_id, round(corr(ret, sq), 8) AS corr FROM l GROUP BY 1",
    "five_sigma": _SIGMA_SQL.format(5.0),
    "large_moves": _SIGMA_SQL.format(2.5),
    "last_100": f"WITH {_RET_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM ret) SELECT series_id, date, t, round(ret, 8) AS ret FROM k WHERE k <= 100",
    "cross_validate": f"{_CROSS_SQL} SELECT series_id, count(*) AS n, round(corr(a, b), 8) AS corr, round(avg(abs(a / b - 1)), 8) AS mean_abs_diff, count(*) FILTER (WHERE a = b) AS n_equal FROM a JOIN b0 USING (series_id, date) GROUP BY 1",
    "lag_shift_check": f"""{_CROSS_SQL}, b AS (SELECT series_id, date, -1 AS shift, lead(b) {_W} AS b FROM b0 UNION ALL SELECT series_id, date, 0, b FROM b0 UNION ALL SELECT series_id, date, 1, lag(b) {_W} FROM b0)
  SELECT series_id, shift, count(*) AS n, round(corr(a, b), 8) AS corr, round(avg(abs(a / b - 1)), 8) AS mean_abs_diff FROM a JOIN b USING (series_id, date) WHERE b IS NOT NULL GROUP BY 1, 2""",
    "zero_volume_diag": f"""WITH {_BARS_SQL}, p AS (SELECT *, ln("close" / lag("close") {_W}) AS ret FROM bars), n AS (SELECT *, CAST(abs(lead(ret) {_W}) > 0.5 AS DOUBLE) AS large FROM p)
  SELECT series_id, round(avg(CAST(volume = 0 AS DOUBLE)), 8) AS zero_share, round(avg(large) FILTER (WHERE volume = 0), 8) AS after_zero, round(avg(large), 8) AS base_rate FROM n GROUP BY 1""",
    "crisis_bands": f"""WITH {_RET_SQL}, b(band, a, z) AS (VALUES {', '.join(f"('{k}', DATE '{a}', DATE '{z}')" for k, (a, z) in BANDS.items())}), r AS (SELECT *, max(date) OVER (PARTITION BY series_id) AS last FROM ret)
  SELECT series_id, date, round(ret * 100, 6) AS ret_pct, band, CASE WHEN z IS NULL THEN last ELSE least(z, last) END AS band_end FROM r LEFT JOIN b ON date BETWEEN a AND z""",
    "var_overlay": f"WITH {_HS_SQL} SELECT series_id, model, date, alpha, round(actual_return * 100, 6) AS ret_pct, round(-var * 100, 6) AS neg_var_pct, coalesce(actual_return < -var, false) AS is_violation FROM hs",
    "return_histogram": f"""WITH {_RET_SQL}, s AS (SELECT series_id, min(ret) AS lo, max(ret) AS hi, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS s, quantile_cont(ret, 0.5) AS med FROM ret GROUP BY 1),
  k AS (SELECT series_id, CAST(least(39, floor((ret - lo) / ((hi - lo) / 40))) AS INTEGER) AS bin, lo, hi, n, m, s, med, count(*) AS c FROM ret JOIN s USING (series_id) WHERE hi > lo GROUP BY ALL),
  e AS (SELECT *, (hi - lo) / 40 AS width, lo + (hi - lo) / 40 * (bin + 0.5) AS centre FROM k)
  SELECT series_id, bin, round(centre, 8) AS centre, round(c / (n * width), 6) AS density, round(exp(-0.5 * pow((centre - m) / s, 2)) / (s * 2.5066282746310002), 6) AS normal_density, round(med, 8) AS median FROM e""",
    "refit_schedule": f"WITH {_RET_SQL} SELECT series_id, date, t, CAST(t - (t - 251) % 42 AS INTEGER) AS refit_t, (t - 251) % 42 = 0 AS is_refit FROM ret WHERE t > 250",
    "garch_filter_fixed": f"""WITH {_RET_SQL}, w AS (SELECT series_id, date, t, list(ret * 100) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {_GW} PRECEDING AND 1 PRECEDING) AS a FROM ret),
  v AS (SELECT series_id, date, t, a, list_sum(list_transform(a, lambda x: x * x)) / {_GW} AS v0 FROM w WHERE t > {_GW})
  SELECT series_id, date, t, round(list_reduce(list_prepend(v0, a), lambda acc, x: {_OMEGA} + {_A1} * x * x + {_B1} * acc), 6) AS variance FROM v""",
    "garch_horizon_fixed": f"""WITH RECURSIVE {_RET_SQL}, w AS (SELECT series_id, date, t, list(ret * 100) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {_GW} PRECEDING AND 1 PRECEDING) AS a FROM ret),
  v AS (SELECT series_id, date, t, 1 AS h, list_reduce(list_prepend(list_sum(list_transform(a, lambda x: x * x)) / {_GW}, a), lambda acc, x: {_OMEGA} + {_A1} * x * x + {_B1} * acc) AS variance FROM w WHERE t > {_GW}
    UNION ALL SELECT series_id, date, t, h + 1, {_OMEGA} + {_A1} * variance + {_B1} * variance FROM v WHERE h < 10)
  SELECT series_id, date, t, h, round(variance, 6) AS variance FROM v""",
    "as_of_backward": f"{_EVENTS_SQL} SELECT l.*, event_id_right, CAST(epoch(b.hour) AS BIGINT) AS hour_right, value_right FROM l ASOF LEFT JOIN back AS b ON l.user_id = b.user_id AND l.hour >= b.hour",
    "as_of_forward": f"""{_EVENTS_SQL}, j AS (SELECT l.*, event_id_right, a.hour AS hour_right, value_right, a.hour - l.hour <= INTERVAL 6 HOUR AS ok FROM l ASOF LEFT JOIN ahead AS a ON l.user_id = a.user_id AND l.hour < a.hour)
  SELECT event_id, user_id, hour, value, CASE WHEN ok THEN event_id_right END AS event_id_right, CASE WHEN ok THEN CAST(epoch(hour_right) AS BIGINT) END AS hour_right, CASE WHEN ok THEN value_right END AS value_right FROM j""",
    "as_of_nearest": f"""{_EVENTS_SQL}, b AS (SELECT l.*, event_id_right AS bi, b.hour AS bh, value_right AS bv FROM l ASOF LEFT JOIN back AS b ON l.user_id = b.user_id AND l.hour >= b.hour),
j AS (SELECT b.*, event_id_right AS ai, a.hour AS ah, value_right AS av FROM b ASOF LEFT JOIN ahead AS a ON b.user_id = a.user_id AND b.hour <= a.hour),
k AS (SELECT *, ah IS NOT NULL AND (bh IS NULL OR ah - hour < hour - bh) AS later FROM j),
r AS (SELECT event_id, user_id, hour, value, CASE WHEN later THEN ai ELSE bi END AS i, CASE WHEN later THEN ah ELSE bh END AS h, CASE WHEN later THEN av ELSE bv END AS v FROM k)
SELECT event_id, user_id, hour, value, CASE WHEN ok THEN i END AS event_id_right, CASE WHEN ok THEN CAST(epoch(h) AS BIGINT) END AS hour_right, CASE WHEN ok THEN v END AS value_right
  FROM (SELECT *, h - hour <= INTERVAL 1 DAY AND hour - h <= INTERVAL 1 DAY AS ok FROM r)""",
}
