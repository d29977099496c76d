"""Scans by buckets, as-of joins, sliding order statistics and horizons."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import backtests, garch, returns, rolling, scans, sliding
from tidemark.plans import catalog

DAY = datetime.date(2001, 1, 1)


def _prices(seed, n=400, series=3):
    rng = random.Random(seed)
    rows = []
    for s in range(series):
        day = DAY
        for _ in range(rng.randint(1, n)):
            day += datetime.timedelta(days=rng.choice([1, 1, 1, 3, 40]))
            rows.append((f"s{s}", day, rng.choice([None, 0.0, -1.0, 1.5, 2.5, 7.0, 3.0])))
    return rows


@pytest.mark.parametrize("width", [1, 7, 100, 4096])
def test_returns_across_buckets(spark, width):
    rows = _prices(1)
    want, before, t = [], {}, {}
    for s, d, p in rows:
        q = before.get(s)
        if p and q and p > 0 and q > 0:
            t[s] = t.get(s, 0) + 1
            want.append((s, d, t[s], p, pytest.approx(np.log(p / q))))
        before[s] = p
    df = spark.createDataFrame(rows, "series_id string, date date, price double").repartition(3)
    assert [tuple(r) for r in returns.log_returns(df, width).orderBy("series_id", "date").collect()] == want
    assert returns.log_returns(df.limit(0), width).count() == 0


def test_carried_values(spark):
    rows = [(k % 3, k, None if k % 4 else k * 10) for k in range(90)]
    df = scans.bucketed(spark.createDataFrame(rows, "g int, at long, x int"), "at", 5)
    got = scans.scanned(df, ("g",), ["at"], "x", number="number", last="upto", before="before").orderBy("g", "at").collect()
    state = {}
    for r in got:
        n, last, prev = state.get(r.g, (0, None, None))
        last = r.x if r.x is not None else last
        assert (r.number, r.last, r.before) == (n + 1, last, prev)
        state[r.g] = (n + 1, last, r.x)


@pytest.mark.parametrize("name", ["log_returns", "hit_transitions", "return_summary", "kupiec"])
def test_no_window_over_a_whole_series(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\]", plan)
    assert windows and all("_b#" in w or "block#" in w for w in windows), windows


@pytest.mark.parametrize("width", [1, 3, 50, 4096])
def test_transitions_across_buckets(spark, width):
    rng, rows = random.Random(2), []
    for s in ("a", "b"):
        rows += [(s, "m", 0.05, t, rng.choice([None, -2.0, 0.5, -3.0]), rng.choice([None, 1.0, 1.0]), 2.0) for t in range(1, 121)]
    rows += [("none", "m", 0.05, t, None, 1.0, 2.0) for t in range(3)]
    df = spark.createDataFrame(rows, "series_id string, model string, alpha double, t int, actual_return double, var double, es double").repartition(4)
    got = {r.series_id: r for r in backtests.counts(df, width).collect()}
    for s in ("a", "b", "none"):
        hits = [int(r < -v) for x, _, _, _, r, v, _ in rows if x == s and r is not None and v is not None]
        n = {k: sum(p == k for p in zip(hits, hits[1:])) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
        g = got[s]
        assert (g.n_obs, g.n_violations, g.n00, g.n01, g.n10, g.n11) == (len(hits), sum(hits), n[0, 0], n[0, 1], n[1, 0], n[1, 1])
    bare = backtests.table(df.drop("es"), Config(simulations=5)).where("series_id = 'a'").first()
    assert bare.as_z2 is None and bare.as_p is None and not bare.as_passed and bare.kupiec_lr is not None


def _found(left, right, direction, tolerance, exact):
    out = []
    for i, k, t in left:
        best = None
        if k is not None and t is not None:
            for j, kk, u in right:
                if kk != k or u is None or (u == t and not exact):
                    continue
                for way in (("backward", "forward") if direction == "nearest" else (direction,)):
                    off = t - u if way == "backward" else u - t
                    if off < 0 or (tolerance is not None and off > tolerance):
                        continue
                    # an even distance: backward; of one time the last, or forward the first
                    cand = (off, way == "forward", -j if way == "backward" else j)
                    if best is None or cand < best[0]:
                        best = (cand, j, u)
        out.append((i, k, t, best and best[1], best and best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", scans.DIRECTIONS)
@pytest.mark.parametrize("tolerance,exact,width", [(None, True, 4096), (3, True, 2), (5, False, 7), (0, True, 1)])
def test_as_of_like_brute_force(spark, direction, tolerance, exact, width):
    rng = random.Random(3)
    left = [(i, rng.choice(["a", "b", None, "only left"]), rng.choice([None, *range(-20, 60)])) for i in range(120)]
    left += left[:5]  # repeats stay
    right = [(i, rng.choice(["a", "b", None, "only right"]), rng.choice([None, *range(-25, 70, 3), 10, 10])) for i in range(80)]
    l, r = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "j int, k string, t long")
    got = scans.as_of(l, r, ("k",), "t", ["j"], direction, tolerance, exact, width)
    assert got.columns == ["i", "k", "t", "j_right", "t_right"]
    assert sorted(map(tuple, got.collect()), key=str) == _found(left, right, direction, tolerance, exact)
    assert scans.as_of(l, r.limit(0), ("k",), "t", ["j"], direction).where("j_right is null").count() == len(left)
    assert scans.as_of(l.limit(0), r, ("k",), "t", ["j"], direction).count() == 0


def test_as_of_dates_and_times(spark):
    l = spark.createDataFrame([("a", DAY), ("a", DAY + datetime.timedelta(days=9))], "k string, d date")
    r = spark.createDataFrame([("a", DAY - datetime.timedelta(days=2), 5.0)], "k string, d date, x double")
    assert [x.x_right for x in scans.as_of(l, r, ("k",), "d", ["x"], tolerance=5).orderBy("d").collect()] == [5.0, None]
    at = datetime.datetime(2020, 1, 1, 0, 0, 0, 500_000)
    l = spark.createDataFrame([("a", at)], "k string, ts timestamp")
    r = spark.createDataFrame([("a", at - datetime.timedelta(microseconds=1), 1), ("a", at + datetime.timedelta(microseconds=1), 2)], "k string, ts timestamp, x int")
    assert scans.as_of(l, r, ("k",), "ts", ["x"]).first().x_right == 1
    assert scans.as_of(l, r, ("k",), "ts", ["x"], "forward", tolerance=1e-6).first().x_right == 2
    with pytest.raises(ValueError):
        scans.as_of(l, r, ("k",), "ts", ["x"], "sideways")


@pytest.mark.parametrize("window", [1, 2, 7, 100])
def test_sliding_tails(window):
    rng = np.random.default_rng(4)
    for values in (rng.standard_normal(300), rng.integers(-2, 3, 300).astype(float), np.zeros(120), rng.standard_normal(window), np.repeat(rng.standard_normal(60), 3)):
        got = sliding.rolling_tails(values, window, (0.01, 0.05, 0.5))
        assert got.shape == (max(0, len(values) - window), 3, 2)
        for i in range(len(got)):
            w = values[i: i + window]
            for j, a in enumerate((0.01, 0.05, 0.5)):
                q = np.quantile(w, a)
                assert got[i, j, 0] == pytest.approx(q, abs=1e-12)
                below = w[w < got[i, j, 0]]
                assert got[i, j, 1] == pytest.approx(below.mean(), abs=1e-9) if len(below) else np.isnan(got[i, j, 1])


def test_variances_ahead():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2, 120))
    theta = np.array([[0.0, np.log(0.05), np.log(2.0), np.log(1.0), np.log(15.0)]] * 2)  # GARCH(2, 1)
    v = garch.variances_ahead(x, theta, "GARCH", 60, [(1,), (2,)], p=2)
    assert v[:, 0] == pytest.approx(garch.filtered(x, theta, "GARCH", p=2)[1])
    _, c, a, _, b = garch._unpack(theta, "GARCH", 2, 1, 0)
    assert v[:, 1] == pytest.approx(c + a[:, 0] * v[:, 0] + a[:, 1] * x[:, -1] ** 2 + b[:, 0] * v[:, 0])
    assert v[:, 2] == pytest.approx(c + (a[:, 0] + b[:, 0]) * v[:, 1] + a[:, 1] * v[:, 0])
    e = np.array([[0.0, 0.01, 0.2, -0.1, np.arctanh(0.9)]] * 2)
    one = garch.variances_ahead(x, e, "EGARCH", 5, [(1, 2), (1, 3)], o=1, paths=200_000)
    assert one[:, 0] == pytest.approx(garch.filtered(x, e, "EGARCH", o=1)[1])
    # the day after next: c + b ln v + g z + a (|z| - root), a lognormal-like mean by quadrature
    z, w = np.polynomial.hermite_e.hermegauss(80)
    for r in range(2):
        want = (np.exp(0.01 + 0.9 * np.log(one[r, 0]) - 0.1 * z + 0.2 * (np.abs(z) - np.sqrt(2 / np.pi))) * w).sum() / w.sum()
        assert one[r, 1] == pytest.approx(want, rel=5e-3)
    assert garch.variances_ahead(x[::-1], e, "EGARCH", 5, [(1, 3), (1, 2)], o=1, paths=200_000) == pytest.approx(one[::-1])


@pytest.mark.parametrize("kind", ["GARCH", "EGARCH"])
def test_horizon_forecasts(spark, kind):
    rng = np.random.default_rng(6)
    rows = [(s, DAY + datetime.timedelta(days=t), t, float(0.01 * rng.standard_normal())) for s in ("a", "b") for t in range(1, 111)]
    rows += [("flat", DAY + datetime.timedelta(days=t), t, 0.0) for t in range(1, 103)]
    r = spark.createDataFrame(rows, "series_id string, date date, t int, ret double")
    c = Config(window=100, block=4)
    got = garch.horizon_forecasts(r, c, kind, 3).repartition(5)
    today = {(x.series_id, x.t, x.alpha): x for x in garch.forecasts(r, c, kind).collect()}
    rows = got.collect()
    assert len(rows) == 2 * 3 * (10 + 10 + 2)
    for x in rows:
        y = today[x.series_id, x.t, x.alpha]
        assert x.estimation_failed == (x.series_id == "flat") == (x.var is None)
        if x.h == 1 and x.var is not None:
            assert (x.var, x.es) == (pytest.approx(y.var), pytest.approx(y.es))
    other = {(x.series_id, x.t, x.h, x.alpha): x.var for x in garch.horizon_forecasts(r, Config(window=100, block=100), kind, 3).collect()}
    assert all(other[x.series_id, x.t, x.h, x.alpha] == (x.var if x.var is None else pytest.approx(x.var)) for x in rows)
    with pytest.raises(ValueError):
        garch.horizon_forecasts(r, c, kind, 0)


def test_fixed_horizon_edges(spark):
    rng = np.random.default_rng(7)
    r = spark.createDataFrame([("a", DAY + datetime.timedelta(days=t), t, float(rng.standard_normal() / 100)) for t in range(1, 31)], "series_id string, date date, t int, ret double")
    for omega, a, b in ((0.05, 0.1, 0.85), (0.05, 0.25, 0.75)):
        got = {(x.t, x.h): x.variance for x in rolling.fixed_garch_ahead(r, omega, a, b, 20, 4).collect()}
        first = {x.t: x.variance for x in rolling.fixed_garch(r, omega, a, b, 20).collect()}
        for t, v in first.items():
            for h in range(1, 5):
                assert got[t, h] == pytest.approx(v)
                v = omega + (a + b) * v


def test_orders_compared(spark):
    rng = np.random.default_rng(8)
    r = spark.createDataFrame([("a", DAY + datetime.timedelta(days=t), t, float(rng.standard_normal() / 100)) for t in range(1, 90)], "series_id string, date date, t int, ret double")
    c = Config(window=80)
    got = {(x.p, x.q): x for x in garch.compared(r, c, ((1, 1, 0), (2, 1, 0))).collect()}
    fits = {o: {x.t: x for x in garch.forecasts(r, c, "GARCH", *o, with_fit=True).where("alpha = 0.01").collect()} for o in ((1, 1, 0), (2, 1, 0))}
    for o, other in (((1, 1, 0), (2, 1, 0)), ((2, 1, 0), (1, 1, 0))):
        f, g = fits[o], fits[other]
        x = got[o[0], o[1]]
        assert x.n == 9 and x.aic == pytest.approx(np.mean([y.aic for y in f.values()])) and x.bic == pytest.approx(np.mean([y.bic for y in f.values()]))
        assert x.n_best_bic == sum(f[t].bic < g[t].bic or (f[t].bic == g[t].bic and o < other) for t in f)
    assert got[1, 1].n_best_aic + got[2, 1].n_best_aic == 9
    assert {x.converged for x in fits[1, 1, 0].values()} <= {True, False}
