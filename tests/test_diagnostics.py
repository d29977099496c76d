"""Diagnostics that SQL cannot say, against numpy on known series."""

import math

import numpy as np
import pytest

from tidemark.config import Config
from tidemark.operators import diagnostics, garch, returns, sv


def _rows(spark, **series):
    rows = [(k, t + 1, float(x)) for k, v in series.items() for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "series_id string, t int, ret double")


def _ols(y, x):
    b = np.linalg.solve(x.T @ x, x.T @ y)
    e = y - x @ b
    return b, e, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * (e @ e) / (len(y) - x.shape[1]))


def test_arch_lm(spark):
    rng = np.random.default_rng(0)
    calm, v, wild = rng.normal(0, 1, 1500), 1.0, []
    for _ in range(1500):
        wild.append(math.sqrt(v) * rng.standard_normal())
        v = 0.2 + 0.6 * wild[-1] ** 2
    got = {r.series_id: r for r in diagnostics.arch_lm(_rows(spark, calm=calm, wild=wild, short=[0.1, 0.2]), 5).collect()}
    for name, x in (("calm", calm), ("wild", np.array(wild))):
        s = x**2
        y, lags = s[5:], np.column_stack([np.ones(1495), *(s[5 - k: 1500 - k] for k in range(1, 6))])
        _, e, _ = _ols(y, lags)
        assert got[name].n == 1495 and got[name].lm == pytest.approx(1495 * (1 - e @ e / ((y - y.mean()) ** 2).sum()), rel=1e-8)
    # 99.9% of chi-square with 5 degrees of freedom
    assert got["calm"].lm < 20.5 < got["wild"].lm and got["short"].n == 0 and (got["short"].lm is None or math.isnan(got["short"].lm))


def test_adf(spark):
    rng = np.random.default_rng(1)
    noise, walk = rng.normal(0, 1, 800), np.cumsum(rng.normal(0, 1, 800))
    d = _rows(spark, noise=noise, walk=walk)
    plain = {r.series_id: r for r in diagnostics.adf(d, most_lags=0).collect()}
    for name, v in (("noise", noise), ("walk", walk)):
        b, _, se = _ols(np.diff(v), np.column_stack([v[:-1], np.ones(799)]))
        assert plain[name].lags == 0 and plain[name].adf == pytest.approx(b[0] / se[0], rel=1e-8)
    got = {r.series_id: r for r in diagnostics.adf(d).collect()}
    assert got["noise"].adf < got["noise"].critical_1pct and got["walk"].adf > got["walk"].critical_10pct
    v, k = walk, got["walk"].lags  # the statistic of the lag it chose, on the common sample
    most, dv = int(12 * 8**0.25), np.diff(walk)
    b, _, se = _ols(dv[most:], np.column_stack([v[most:-1], np.ones(799 - most), *(dv[most - j: 799 - j] for j in range(1, k + 1))]))
    assert got["walk"].adf == pytest.approx(b[0] / se[0], rel=1e-6)


def test_garch_likelihood_against_a_grid():
    """No point of a grid of parameters has a likelihood above the fit's."""
    rng = np.random.default_rng(2)
    v, r = 1.0, []
    for _ in range(800):
        r.append(math.sqrt(v) * rng.standard_normal())
        v = 0.1 + 0.12 * r[-1] ** 2 + 0.8 * v
    r = np.array(r)
    theta, _, nxt, _ = garch.fit(r[None, :], "GARCH")
    mu, c, a, _, b = garch._unpack(theta, "GARCH", 1, 1, 0)

    def filtered(omega, alpha, beta, mean):
        e = r - mean
        w = 0.94 ** np.arange(75)  # any start within reason; it fades
        h, out = float((w / w.sum()) @ (e[:75] ** 2)), 0.0
        for x in e:
            out += -0.5 * (math.log(2 * math.pi * h) + x * x / h)
            h = omega + alpha * x * x + beta * h
        return out, h

    mine, h = filtered(float(c[0]), float(a[0, 0]), float(b[0, 0]), float(mu[0]))
    assert h == pytest.approx(nxt[0], rel=0.01)
    best = max(filtered(o, x, y, r.mean())[0] for o in (0.02, 0.05, 0.1, 0.15, 0.25) for x in (0.04, 0.08, 0.12, 0.16, 0.2) for y in (0.6, 0.7, 0.75, 0.8, 0.85, 0.9) if x + y < 1)
    assert mine >= best - 0.6


def test_chains_and_priors():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.02, 60)
    for variant in ("SV-Gaussian", "SV-t-Leverage"):
        for priors in (sv.Priors(), sv.FLAT):
            post = sv.Posterior(x, variant, priors)
            u = post.start() + rng.normal(0, 0.1, post.k + 60)
            _, g = post(u)
            for i in range(post.k):
                d = np.zeros(len(u))
                d[i] = 1e-5
                assert g[i] == pytest.approx((post(u + d)[0] - post(u - d)[0]) / 2e-5, rel=2e-4, abs=2e-4)
    draws, converged, rhat, size = sv.fitted(x, "SV-Gaussian", 1, sv.Sampler(60, 60, chains=3, thin=1))
    assert len(draws["mu"]) == 180 and converged == (rhat < 1.01 and size > 400)
    assert sv.fitted(np.zeros(10), "SV-t", 1, sv.Sampler(5, 5)) is None


def test_failed_refit_is_tried_again_the_next_day(spark):
    import datetime

    flat = [0.0] * 20 + [0.01, -0.02, 0.015, 0.01, -0.01, 0.02, 0.01]
    day = datetime.date(2000, 1, 1)
    r = spark.createDataFrame([("s", day + datetime.timedelta(days=i), i + 1, x) for i, x in enumerate(flat)], "series_id string, date date, t int, ret double")
    got = {x.t: x for x in sv.forecasts(r, "SV-Gaussian", Config(window=20, refit_every=6), sv.Sampler(20, 20)).where("alpha = 0.01").collect()}
    assert got[21].estimation_failed and got[21].var is None
    assert not got[22].estimation_failed and len({got[t].var for t in range(22, 28)}) == 1  # the next is due on day 28
