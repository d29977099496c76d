"""GARCH and EGARCH forecasts: Gaussian quasi-maximum likelihood over rolling
windows, all windows of a block fitted at once in numpy."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import stats
from ..sources import store
from .rolling import block_days, blocked, dealt, only_in

_MOST = 50.0
_SUM = 1.05  # the most that a GARCH fit's weights of squares and variances add up to
_STARTS = {"GARCH": ((0.05, 0.90), (0.20, 0.50)), "EGARCH": ((0.10, 0.95), (0.30, 0.60))}
_BATCH = 256  # windows that are fitted at once: a step costs little more for 256 than for 64
_STEPS = (2.0, 1.0, 0.5, 0.2, 0.05, 0.005)


def _parts(nat: np.ndarray, p: int, o: int):
    """(mean, constant, weights of squares, of signs, of variances) of rows."""
    return nat[:, 0], nat[:, 1], nat[:, 2: 2 + p], nat[:, 2 + p: 2 + p + o], nat[:, 2 + p + o:]


def _unpack(theta: np.ndarray, kind: str, p: int, q: int, o: int):
    """Parameters as they enter the recursion; theta is (rows, parameters)."""
    mu, c, a, g, b = _parts(theta, p, o)
    if kind == "GARCH":  # positive, with a sum below _SUM
        e = np.exp(np.clip(np.concatenate([a, b], 1), -_MOST, _MOST))
        e = _SUM * e / (1 + e.sum(1, keepdims=True))
        return mu, np.exp(np.clip(c, -_MOST, _MOST)), e[:, :p], g, e[:, p:]
    return mu, c, a, g, np.tanh(b)


def _pack(nat: np.ndarray, kind: str, p: int, o: int) -> np.ndarray:
    """theta of natural parameters."""
    theta = nat.copy()
    if kind == "GARCH":
        e = nat[:, 2:] / _SUM
        theta[:, 1] = np.log(nat[:, 1])
        theta[:, 2:] = np.log((e / (1 - e.sum(1, keepdims=True)).clip(1e-12)).clip(math.exp(-_MOST)))
    else:
        theta[:, 2 + p + o:] = np.arctanh(nat[:, 2 + p + o:])
    return theta


def filtered(x: np.ndarray, theta: np.ndarray, kind: str, p: int = 1, q: int = 1, o: int = 0, with_state: bool = False):
    """(loglik, next variance) of each row of x (rows, days); loglik is by day.
    Before the first day stands an exponentially weighted mean of the first 75
    squares. with_state adds the last q variances (EGARCH: their logarithms),
    squares and standardised days, the latest first."""
    like, v, _, state = _recursion(x, _unpack(theta, kind, p, q, o), kind, p, q, o)
    return (like.T, v, state) if with_state else (like.T, v)


def _recursion(x: np.ndarray, parts, kind: str, p: int, q: int, o: int, scores: bool = False):
    """(loglik (days, rows), next variance, scores (days, parameters, rows) or
    None, state) of natural parameters; the scores are the recursion's own
    derivatives, carried along with it."""
    mu, c, a, g, b = parts
    plain = kind == "GARCH"
    m, n = x.shape
    k = 2 + p + q + o
    e = x - mu[:, None]
    w = 0.94 ** np.arange(min(75, n))
    w /= w.sum()
    start = np.einsum("ij,j->i", e[:, : len(w)] ** 2, w).clip(1e-12)
    like = np.empty((n, m))
    old_v = [start] * q if plain else [np.log(start)] * q
    old_s = [start] * p
    old_z = [np.zeros(m)] * max(p, o)
    if scores:
        score = np.empty((n, k, m))
        d_start = np.zeros((k, m))
        d_start[0] = -2 * np.einsum("ij,j->i", e[:, : len(w)], w)
        d_v = [d_start if plain else d_start / start] * q
        d_s = [d_start[0]] * p
        d_z = [np.zeros((k, m))] * max(p, o)
    root = math.sqrt(2 / math.pi)
    et = np.ascontiguousarray(e.T)
    for t in range(n + 1):
        if plain:
            raw = c + sum(a[:, i] * old_s[i] for i in range(p)) + sum(b[:, j] * old_v[j] for j in range(q))
            v = kept = np.clip(raw, 1e-12, 1e12)
        else:
            raw = c + sum(b[:, j] * old_v[j] for j in range(q)) + sum(g[:, i] * old_z[i] for i in range(o))
            if t:
                raw = raw + sum(a[:, i] * (np.abs(old_z[i]) - root) for i in range(p))
            kept = np.clip(raw, -_MOST / 2, _MOST / 2)
            v = np.exp(kept)
        if t == n:
            return like, v, score if scores else None, (old_v, old_s, old_z)
        u = et[t] ** 2 / v
        like[t] = -0.5 * (math.log(2 * math.pi) + np.log(v) + u)
        z = et[t] / np.sqrt(v)
        if scores:
            d = sum(b[:, j] * d_v[j] for j in range(q))
            d[1] += 1
            for j in range(q):
                d[2 + p + o + j] += old_v[j]
            for i in range(p):
                if plain:
                    d[2 + i] += old_s[i]
                    d[0] += a[:, i] * d_s[i]
                elif t:
                    d[2 + i] += np.abs(old_z[i]) - root
                    d += a[:, i] * np.sign(old_z[i]) * d_z[i]
            for i in range(o):
                d[2 + p + i] += old_z[i]
                d += g[:, i] * d_z[i]
            d[:, raw != kept] = 0
            rel = d / v if plain else d  # of the variance's logarithm
            score[t] = 0.5 * (u - 1) * rel
            score[t, 0] += et[t] / v
            d_v = [d, *d_v[:-1]]
            d_s = [-2 * et[t], *d_s[:-1]]
            if not plain:
                dz = -0.5 * z * rel
                dz[0] -= 1 / np.sqrt(v)
                d_z = [dz, *d_z[:-1]]
        old_v = [kept, *old_v[:-1]]
        old_s = [et[t] ** 2, *old_s[:-1]]
        old_z = [z, *old_z[:-1]]


def _begun(x: np.ndarray, kind: str, p: int, q: int, o: int):
    """(start, low, high), each (starts, rows, parameters): natural parameters
    from a row's own moments, and the box they may move in."""
    mean, sd = x.mean(axis=1), x.std(axis=1).clip(1e-5)
    k, first_b = 2 + p + q + o, 2 + p + o
    at = np.zeros((len(_STARTS[kind]), len(x), k))
    low, high = np.full_like(at, -np.inf), np.full_like(at, np.inf)
    at[:, :, 0], low[:, :, 0], high[:, :, 0] = mean, mean - 10 * sd, mean + 10 * sd
    for s, (a, b) in enumerate(_STARTS[kind]):
        at[s, :, 1] = (1 - a - b) * sd**2 if kind == "GARCH" else (1 - b) * np.log(sd**2)
        at[s, :, 2: 2 + p], at[s, :, first_b:] = a / p, b / q
    if kind == "GARCH":
        low[:, :, 1], high[:, :, 1] = 1e-8 * sd**2, 10 * sd**2
        low[:, :, 2:], high[:, :, 2:] = 0, _SUM
    else:
        low[:, :, first_b:], high[:, :, first_b:] = -0.99999, 0.99999
    return at, low, high


def _inside(nat: np.ndarray, low: np.ndarray, high: np.ndarray, kind: str) -> np.ndarray:
    """The nearest parameters of the box, GARCH weights scaled to their sum."""
    nat = np.clip(nat, low, high)
    if kind == "GARCH":
        nat[..., 2:] *= np.minimum(1, _SUM * (1 - 1e-9) / nat[..., 2:].sum(-1, keepdims=True).clip(1e-12))
    return nat


def fit(x: np.ndarray, kind: str = "GARCH", p: int = 1, q: int = 1, o: int = 0, rounds: int = 60):
    """(theta, loglik, next variance, converged) of each row of x (percent).

    Natural parameters in a box: a GARCH variance need not be stationary, its
    weights may add up to _SUM. Steps along the scores' outer product (Berndt,
    Hall, Hall and Hausman), the scores by recursion; parameters that stand at a
    bound and would leave it are held; of several step lengths the best is taken.
    Each row starts twice from its own moments and keeps the better end, so what
    else is in the block has no part.
    """
    m, n = x.shape
    at, low, high = (v.reshape(-1, 2 + p + q + o) for v in _begun(x, kind, p, q, o))
    k, rows = at.shape[1], np.tile(x, (len(_STARTS[kind]), 1))
    best = _recursion(rows, _parts(at, p, o), kind, p, q, o)[0].sum(0)
    done, eye = np.zeros(len(rows), bool), np.eye(k)
    for _ in range(rounds):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        now, lo, hi, y = at[live], low[live], high[live], rows[live]
        score = _recursion(y, _parts(now, p, o), kind, p, q, o, scores=True)[2]
        up = score.sum(0).T
        opg = np.einsum("tim,tjm->mij", score, score)
        size = np.sqrt(np.einsum("mii->mi", opg)).clip(1e-150)
        free = ~(((now <= lo) & (up < 0)) | ((now >= hi) & (up > 0)))
        opg = np.where(free[:, :, None] & free[:, None, :], opg / size[:, :, None] / size[:, None, :], 0) + eye * (~free[:, :, None] + 1e-8)
        way = np.linalg.solve(opg, np.where(free, up / size, 0)[:, :, None])[:, :, 0] / size
        tried = np.concatenate([_inside(now + s * way, lo, hi, kind) for s in _STEPS])
        total = _recursion(np.tile(y, (len(_STEPS), 1)), _parts(tried, p, o), kind, p, q, o)[0].sum(0).reshape(len(_STEPS), -1)
        total = np.nan_to_num(total, nan=-np.inf)
        pick, i = total.argmax(0), np.arange(len(live))
        gain = total[pick, i] - best[live]
        take = gain > 0
        at[live[take]] = tried.reshape(len(_STEPS), -1, k)[pick, i][take]
        best[live[take]] += gain[take]
        done[live[gain < 1e-7 * n / 1000]] = True
    end = best.reshape(-1, m).argmax(0) * m + np.arange(m)
    theta = _pack(at[end], kind, p, o)
    like, v = filtered(x, theta, kind, p, q, o)
    return theta, like.sum(1), v, done[end]


def variances_ahead(x: np.ndarray, theta: np.ndarray, kind: str, horizon: int, keys: list[tuple[int, ...]], p: int = 1, q: int = 1, o: int = 0, paths: int = 1000) -> np.ndarray:
    """(rows, horizon): the expected variance of each of the next days.

    GARCH: the recursion, a square being its variance where it is yet to come.
    EGARCH has no closed form beyond the next day: the mean over simulated paths,
    whose numbers come from the row's key, so that they depend on nothing else.
    """
    _, v, (old_v, old_s, old_z) = filtered(x, theta, kind, p, q, o, with_state=True)
    _, c, a, g, b = _unpack(theta, kind, p, q, o)
    out = np.empty((len(x), horizon))
    out[:, 0] = v
    if horizon == 1:
        return out
    if kind == "GARCH":
        for h in range(1, horizon):
            old_v, old_s = [v, *old_v[:-1]], [v, *old_s[:-1]]
            v = np.clip(c + sum(a[:, i] * old_s[i] for i in range(p)) + sum(b[:, j] * old_v[j] for j in range(q)), 1e-12, 1e12)
            out[:, h] = v
        return out
    root, lags = math.sqrt(2 / math.pi), max(p, o)
    for r, key in enumerate(keys):
        z = np.random.default_rng(key).standard_normal((horizon, paths))
        lv = np.full(paths, math.log(v[r]))
        was_v, was_z = [np.full(paths, u[r]) for u in old_v], [np.full(paths, u[r]) for u in old_z]
        for h in range(1, horizon):
            was_v, was_z = [lv, *was_v[:-1]], [z[h - 1], *was_z[: lags - 1]]
            lv = c[r] + sum(b[r, j] * was_v[j] for j in range(q)) + sum(g[r, i] * was_z[i] for i in range(o)) + sum(a[r, i] * (np.abs(was_z[i]) - root) for i in range(p))
            lv = np.clip(lv, -_MOST / 2, _MOST / 2)
            out[r, h] = np.exp(lv).mean()
    return out


def horizon_forecasts(returns: DataFrame, c: Config, kind: str = "GARCH", horizon: int = 10, p: int = 1, q: int = 1, o: int = 0, mean: str = "zero", paths: int = 1000) -> DataFrame:
    """(series_id, model, date, t, h, alpha, variance, var, es,
    estimation_failed): figures of the return of day t + h - 1 as seen before t,
    from the fit of the window before t; h = 1 is forecasts(). variance is in
    percent squared."""
    if kind not in ("GARCH", "EGARCH") or horizon < 1:
        raise ValueError(f"no horizon {horizon} of {kind!r}")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r, at = pdf["ret"].to_numpy() * 100, np.flatnonzero(pdf["target"].to_numpy())
        x = np.lib.stride_tricks.sliding_window_view(r, c.window)[at - c.window]
        ok, t, name = x.std(axis=1) > 0, pdf["t"].to_numpy()[at], zlib.crc32(str(pdf["series_id"].iloc[0]).encode())
        mu, v = np.full(len(at), np.nan), np.full((len(at), horizon), np.nan)
        for low in range(0, len(at), _BATCH):
            rows = np.arange(low, min(low + _BATCH, len(at)))
            rows = rows[ok[rows]]
            if len(rows):
                some = np.ascontiguousarray(x[rows])
                theta = fit(some, kind, p, q, o)[0]
                mu[rows] = theta[:, 0] if mean == "fitted" else 0.0
                v[rows] = variances_ahead(some, theta, kind, horizon, [(c.seed, name, int(k)) for k in t[rows]], p, q, o, paths)
        good, s = np.isfinite(v), np.sqrt(v)
        days, out = pdf.iloc[at], []
        for a in c.alphas:
            for h in range(horizon):
                g = good[:, h]
                out.append(pd.DataFrame({
                    "series_id": days["series_id"].to_numpy(), "model": kind, "date": days["date"].to_numpy(), "t": t, "h": h + 1, "alpha": a, "variance": v[:, h],
                    "var": np.where(g, -(mu + s[:, h] * stats.z(a)) / 100, np.nan), "es": np.where(g, -(mu - s[:, h] * stats.tail_density(a)) / 100, np.nan), "estimation_failed": ~g,
                }))
        got = pd.concat(out, ignore_index=True)
        return got.astype(object).where(got.notna(), None)

    schema = "series_id string, model string, date date, t int, h int, alpha double, variance double, var double, es double, estimation_failed boolean"
    b = blocked(returns.select("series_id", "date", "t", "ret"), c.window, c.window + 1, c.block)
    return dealt(b).applyInPandas(one, schema)


def forecasts(returns: DataFrame, c: Config, kind: str = "GARCH", p: int = 1, q: int = 1, o: int = 0, mean: str = "zero", with_fit: bool = False, parts: DataFrame | None = None) -> DataFrame:
    """Long forecasts (model GARCH or EGARCH), refitted each day.

    mean: "zero", or "fitted" to add the fitted constant. A window without
    variance or a fit that is not finite counts as failed, with null figures.
    with_fit adds loglik, aic, bic and converged (whether the fit's steps had
    ended; a fit is used all the same). parts: the blocks (series_id, block) that
    are made.
    """
    if kind not in ("GARCH", "EGARCH"):
        raise ValueError(f"unknown volatility model {kind!r}")
    k = 2 + p + q + o

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        r = pdf["ret"].to_numpy() * 100
        at = np.flatnonzero(pdf["target"].to_numpy())
        x = np.lib.stride_tricks.sliding_window_view(r, c.window)[at - c.window]
        ok = x.std(axis=1) > 0
        mu, s, ll = (np.full(len(at), np.nan) for _ in range(3))
        ended = np.zeros(len(at), bool)
        for low in range(0, len(at), _BATCH):
            rows = np.arange(low, min(low + _BATCH, len(at)))
            rows = rows[ok[rows]]
            if len(rows):
                theta, ll[rows], v, ended[rows] = fit(np.ascontiguousarray(x[rows]), kind, p, q, o)
                mu[rows], s[rows] = (theta[:, 0] if mean == "fitted" else 0.0), np.sqrt(v)
        good = np.isfinite(s) & np.isfinite(ll)
        rows = pdf.iloc[at]
        out = []
        for a in c.alphas:
            out.append(pd.DataFrame({
                "series_id": rows["series_id"].to_numpy(), "model": kind, "date": rows["date"].to_numpy(), "t": rows["t"].to_numpy(), "alpha": a, "actual_return": rows["ret"].to_numpy(),
                "var": np.where(good, -(mu + s * stats.z(a)) / 100, np.nan), "es": np.where(good, -(mu - s * stats.tail_density(a)) / 100, np.nan), "estimation_failed": ~good,
                "loglik": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(c.window) - 2 * ll, "converged": ended & good,
            }))
        got = pd.concat(out, ignore_index=True)
        return got.astype(object).where(got.notna(), None)

    schema = "series_id string, model string, date date, t int, alpha double, actual_return double, var double, es double, estimation_failed boolean, loglik double, aic double, bic double, converged boolean"
    b = only_in(blocked(returns.select("series_id", "date", "t", "ret"), c.window, c.window + 1, block_days(kind, c)), parts)
    got = dealt(b).applyInPandas(one, schema)
    return got if with_fit else got.drop("loglik", "aic", "bic", "converged")


def compared(returns: DataFrame, c: Config, orders: tuple[tuple[int, int, int], ...] = ((1, 1, 0), (1, 2, 0), (2, 1, 0)), kind: str = "GARCH") -> DataFrame:
    """(series_id, model, p, q, o, n, loglik, aic, bic, n_best_aic, n_best_bic):
    the mean figures of each order over all windows of a series, and in how many
    of them it has the least (ties: the first order)."""
    each = None
    for i, (p, q, o) in enumerate(orders):
        f = forecasts(returns, c, kind, p, q, o, with_fit=True).where(F.col("alpha") == c.alphas[0])
        f = f.select("series_id", "model", "t", F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(o).alias("o"), "loglik", "aic", "bic")
        each = f if each is None else each.unionByName(f)
    each = store.staged(each, "orders")  # it is read twice
    least = each.groupBy("series_id", "t").agg(*(F.min_by("i", F.when(F.col(m).isNotNull(), F.struct(m, "i"))).alias(f"best_{m}") for m in ("aic", "bic")))
    j = each.join(least, ["series_id", "t"])
    return j.groupBy("series_id", "model", "p", "q", "o").agg(
        F.count("loglik").alias("n"), F.avg("loglik").alias("loglik"), F.avg("aic").alias("aic"), F.avg("bic").alias("bic"),
        F.count_if(F.col("i") == F.col("best_aic")).alias("n_best_aic"), F.count_if(F.col("i") == F.col("best_bic")).alias("n_best_bic"),
    )
