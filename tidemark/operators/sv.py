"""Stochastic-volatility forecasts: four observation densities, sampled by the
No-U-Turn method with analytic gradients in coordinates that are nearly white."""

from __future__ import annotations

import copy
import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..sources import store
from . import chains, nuts
from .rolling import FORECAST, blocked, dealt

#: variant -> (Student-t observations, correlated innovations)
VARIANTS = {"SV-Gaussian": (False, False), "SV-t": (True, False), "SV-Leverage": (False, True), "SV-t-Leverage": (True, True)}


@dataclass(frozen=True)
class Priors:
    """mu Normal(mu_mean, mu_sd); (phi + 1) / 2 Beta(phi_a, phi_b); sigma
    half-Cauchy of scale sigma; nu Gamma(nu_shape, nu_rate)."""

    mu_mean: float = -10.0
    mu_sd: float = 3.0
    phi_a: float = 20.0
    phi_b: float = 1.5
    sigma: float = 0.5
    nu_shape: float = 2.0
    nu_rate: float = 0.1


#: Wider alternatives, for robustness.
FLAT = Priors(mu_sd=10.0, phi_a=5.0, phi_b=1.0, sigma=1.0, nu_shape=1.0, nu_rate=0.05)


@dataclass(frozen=True)
class Sampler:
    """draws and tune a chain; accept: the mean acceptance that the step is tuned
    to; most_depth: doublings of a trajectory; thin: transitions a draw. One chain
    counts as converged with an effective size of over 200; several with all
    rank-normalised split R-hat under 1.01 and a size of over 400."""

    draws: int = 500
    tune: int = 300
    accept: float = 0.7
    most_depth: int = 10
    thin: int = 2
    use_rho: bool = False  # whether the next return feels the correlation
    chains: int = 1
    priors: Priors = Priors()


def _digamma(x: float) -> float:
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


class Posterior:
    """Log density and gradient over (mu, logit of (phi + 1) / 2, log sigma,
    [log nu], [atanh rho], z), with the latent log variance mu + sigma z. rho is
    uniform, z a unit autoregression. r may be many windows, a row each; so are
    the points then.
    """

    def __init__(self, r: np.ndarray, variant: str, priors: Priors = Priors()):
        if variant not in VARIANTS:
            raise ValueError(f"unknown variant {variant!r}")
        self.r, (self.heavy, self.lever) = r, VARIANTS[variant]
        self.k, self.priors = 3 + self.heavy + self.lever, priors

    def parts(self, u: np.ndarray):
        """mu, (phi + 1) / 2, phi, sigma, nu and rho as columns, and z."""
        raw = 1 / (1 + np.exp(-u[..., 1:2]))
        nu = np.exp(u[..., 3:4]) if self.heavy else np.zeros_like(raw)
        rho = np.tanh(u[..., self.k - 1: self.k]) if self.lever else np.zeros_like(raw)
        return u[..., :1], raw, 2 * raw - 1, np.exp(u[..., 2:3]), nu, rho, u[..., self.k:]

    def start(self) -> np.ndarray:
        u = np.zeros((*self.r.shape[:-1], self.k + self.r.shape[-1]))
        u[..., 0], u[..., 1], u[..., 2] = np.log(np.maximum(self.r.var(axis=-1), 1e-12)), math.log(0.975 / 0.025), math.log(0.2)
        if self.heavy:
            u[..., 3] = math.log(15)
        return u

    def astray(self, u: np.ndarray) -> np.ndarray:
        """Points that no step should have come to."""
        return ~np.isfinite(u).all(axis=-1) | (np.abs(u[..., 1: self.k]).max(axis=-1) > 12) | (np.abs(u[..., 0]) > 1000)

    def __call__(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bad = self.astray(u)
        if bad.any():
            u = np.where(bad[..., None], self.start(), u)
        mu, raw, phi, sigma, nu, rho, z = self.parts(u)
        n, q0 = z.shape[-1], self.priors
        h = np.minimum(np.maximum(mu + sigma * z, -60), 60)
        y = self.r * np.exp(-0.5 * h)
        step = z[..., 1:] - phi * z[..., :-1]
        squares = lambda x: np.vecdot(x, x)[..., None]
        like = -0.5 * h.sum(axis=-1, keepdims=True)
        if self.lever:
            eta = np.concatenate([z[..., :1] * (1 - phi), step], axis=-1)
            c2 = np.maximum(1e-6, 1 - rho * rho)
            c = np.sqrt(c2)
            w = (y - rho * eta) / c
            like -= (n - 2) * np.log(c)
        else:
            c, w = 1.0, y
        if self.heavy:
            w2 = w * w
            q = 1 + w2 / nu
            lq = np.log(q).sum(axis=-1, keepdims=True)
            const = np.array([math.lgamma((x + 1) / 2) - math.lgamma(x / 2) - 0.5 * math.log(x * math.pi) for x in nu.ravel()]).reshape(nu.shape)
            like += n * const - (nu + 1) / 2 * lq
            g = -(nu + 1) * w / (nu * q)
        else:
            like -= 0.5 * squares(w) + 0.5 * n * math.log(2 * math.pi)
            g = -w
        z0, v0 = z[..., :1], 1 - phi * phi + 1e-6
        like += 0.5 * np.log(v0) - 0.5 * v0 * z0**2 - 0.5 * squares(step)
        like += -0.5 * ((mu - q0.mu_mean) / q0.mu_sd) ** 2 + q0.phi_a * np.log(raw) + q0.phi_b * np.log1p(-raw) - np.log1p((sigma / q0.sigma) ** 2) + u[..., 2:3]
        dh = -0.5 - g * y / (2 * c)
        grad = np.empty(u.shape)
        dz = grad[..., self.k:]
        np.multiply(sigma, dh, out=dz)
        dz[..., :1] -= v0 * z0
        pull = step
        dphi = phi * z0**2 - phi / v0
        if self.lever:
            de = -g * rho / c
            dz[..., :1] += de[..., :1] * (1 - phi)
            pull = step - de[..., 1:]
            dphi = dphi - de[..., :1] * z0
            like_rho = n * rho / c2 + (g * (-eta / c + w * rho / c2)).sum(axis=-1, keepdims=True)
            grad[..., self.k - 1: self.k] = like_rho * c2 - 2 * rho
        dz[..., 1:] -= pull
        dz[..., :-1] += phi * pull
        along = lambda a, b: np.vecdot(a, b)[..., None]
        dphi = dphi + along(pull, z[..., :-1])
        grad[..., :1] = dh.sum(axis=-1, keepdims=True) - (mu - q0.mu_mean) / q0.mu_sd**2
        grad[..., 1:2] = dphi * 2 * raw * (1 - raw) + q0.phi_a * (1 - raw) - q0.phi_b * raw
        grad[..., 2:3] = sigma * along(dh, z) + 1 - 2 * sigma * sigma / (q0.sigma**2 + sigma * sigma)
        if self.heavy:
            like += q0.nu_shape * u[..., 3:4] - q0.nu_rate * nu
            half = np.array([0.5 * _digamma((x + 1) / 2) - 0.5 * _digamma(x / 2) - 0.5 / x for x in nu.ravel()]).reshape(nu.shape)
            dnu = n * half - 0.5 * lq + (nu + 1) / 2 * (w2 / q).sum(axis=-1, keepdims=True) / (nu * nu)
            grad[..., 3:4] = dnu * nu + q0.nu_shape - q0.nu_rate * nu
        like = np.where(bad, -np.inf, like[..., 0])
        return like, grad


@functools.cache
def _lags(n: int) -> np.ndarray:
    """(n, n): how far the column is after the row; n where it is before."""
    d = np.arange(n)[None, :] - np.arange(n)[:, None]
    return np.where(d < 0, n, d)


class _Filter:
    """y[t] = x[t] + phi y[t - 1] (back: y[t + 1]) for all t < n of each row: the
    days in a square of lines, a line by its matrix of powers, and what a line
    hands on by that of powers of powers. phi is (..., 1)."""

    def __init__(self, phi: np.ndarray, n: int):
        self.n, self.width = n, max(2, math.ceil(math.sqrt(n)))
        self.lines = -(-n // self.width)
        p = phi ** np.arange(self.width + 1)
        self.handed = p[..., None, 1:].copy()
        q = p[..., -1:] ** np.arange(self.lines + 1)
        p[..., -1] = q[..., -1] = 0.0  # before its own day a value counts nothing
        self.inner, self.outer = p[..., _lags(self.width)], q[..., _lags(self.lines)]

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        rows, size = x.shape[:-1], self.lines * self.width
        y = np.zeros((*rows, size))
        y[..., : self.n] = x
        y = y.reshape(*rows, self.lines, self.width)
        if back:
            y = y @ self.inner.swapaxes(-1, -2)
            y[..., :-1, :] += (self.outer @ y[..., :1])[..., 1:, :] * self.handed[..., ::-1]
        else:
            y = y @ self.inner
            y[..., 1:, :] += (self.outer.swapaxes(-1, -2) @ y[..., -1:])[..., :-1, :] * self.handed
        return y.reshape(*rows, size)[..., : self.n]


def _filtered(x: np.ndarray, phi: np.ndarray, back: bool = False) -> np.ndarray:
    return _Filter(phi, x.shape[-1])(x, back)


class Whitened:
    """A Posterior in coordinates (mu, ..., e) where e is close to independent
    and normal whatever the parameters: neither centred nor non-centred.

    The latent x = z sigma has about the precision Q / sigma^2 + c, Q that of its
    autoregression and c the information of a return on its log variance, which
    is again that of an autoregression (phi', sigma'). With its filter F, x = m +
    F (e + F' c (y - mu - m)): y are pseudo-returns, the path of log variances
    that fits best at the start, moved by its score over c. Innovations that are
    correlated with the returns have the mean m, the filtered returns in units of
    that path, and sigma sqrt(1 - rho^2) for sigma. The first coordinate is mu in
    units of how well phi and sigma let it be known, which is little as phi nears
    1. What y and m are changes only how well the coordinates suit; the density
    takes the volume of the map in.
    """

    def __init__(self, post: Posterior):
        self.post, self.k, self.n = post, post.k, post.r.shape[-1]
        self.c = 0.4 if post.heavy else 0.5
        h, self.pseudo = self._path(post.start()[..., :1], np.array([0.95]), np.array([0.25]))
        self.level = self.pseudo.mean(axis=-1, keepdims=True)
        y = post.r * np.exp(-np.clip(h, -60, 60) / 2)
        self.unit = y * (16 / (15 + y * y)) if post.heavy else y

    def rows(self, which: list[int]) -> Whitened:
        """The same of some of the windows."""
        if len(which) == len(self.post.r):
            return self
        out = copy.copy(self)
        out.post = copy.copy(self.post)
        out.post.r, out.pseudo, out.level, out.unit = (x[which] for x in (self.post.r, self.pseudo, self.level, self.unit))
        return out

    def _path(self, mu: np.ndarray, phi: np.ndarray, sigma: np.ndarray, rounds: int = 8):
        """Newton steps on the path of log variances, with expected information."""
        r2, nu = self.post.r**2, 15.0
        h = mu + np.zeros(self.n)
        p, s, _ = self._filter(phi, sigma)
        along = _Filter(p, self.n)
        for _ in range(rounds):
            y2 = r2 * np.exp(-np.clip(h, -60, 60))
            score = 0.5 * ((nu + 1) * y2 / (nu + y2) if self.post.heavy else y2) - 0.5
            pseudo = h + np.clip(score / self.c, -4, 4)
            h = mu + s * along(s * along(self.c * (pseudo - mu), True))
        return h, pseudo

    def _filter(self, phi: np.ndarray, sigma: np.ndarray):
        """phi', sigma' and the derivatives of phi' and log sigma' by phi and log
        sigma."""
        g = self.c * sigma * sigma
        b = 1 + phi * phi + g
        d = np.sqrt(np.maximum(b * b - 4 * phi * phi, 1e-14))
        s = b + d
        s_phi, s_sigma = 2 * phi * (1 + (b - 2) / d), 2 * g * (1 + b / d)
        p = 2 * phi / s
        return p, sigma * np.sqrt(2 / s), (2 / s - p * s_phi / s, -p * s_sigma / s, -0.5 * s_phi / s, 1 - 0.5 * s_sigma / s)

    def _mean(self, unit: np.ndarray, phi: np.ndarray, sigma: np.ndarray):
        """mu, its scale, and the derivatives of both by phi and log sigma."""
        q0 = self.post.priors
        p0, far = 1 / q0.mu_sd**2, sigma * sigma / np.maximum(1e-12, (1 - phi) ** 2)
        a = far + 1 / self.c
        info = self.n / a
        scale = 1 / np.sqrt(p0 + info)
        by_info = [-info / a * x for x in (2 * far / np.maximum(1e-6, 1 - phi), 2 * far)]
        mean = (p0 * q0.mu_mean + info * self.level) * scale * scale
        by_scale = [-0.5 * scale**3 * x for x in by_info]
        return mean + scale * unit, scale, [p0 * (self.level - q0.mu_mean) * scale**4 * x + unit * y for x, y in zip(by_info, by_scale)], [x / scale for x in by_scale]

    def _latent(self, v: np.ndarray):
        """The parameters, x, and what it is made of."""
        raw, sigma = 1 / (1 + np.exp(-v[..., 1:2])), np.exp(v[..., 2:3])
        phi = 2 * raw - 1
        rho = np.tanh(v[..., self.k - 1: self.k]) if self.post.lever else 0.0
        mean = self._mean(v[..., :1], phi, sigma)
        p, s, by = self._filter(phi, sigma * np.sqrt(np.maximum(1e-6, 1 - rho * rho)) if self.post.lever else sigma)
        through, beside = _Filter(p, self.n), _Filter(phi, self.n) if self.post.lever else None
        a = beside(self.unit) if beside else 0.0
        m = sigma * rho * a
        w = s * through(self.c * (self.pseudo - mean[0] - m), True)
        drive = v[..., self.k:] + w
        own = s * through(drive)
        return mean, raw, phi, sigma, rho, (through, beside), s, by, a, m, w, drive, own

    def to_posterior(self, v: np.ndarray) -> np.ndarray:
        """The Posterior's coordinates of v."""
        mean, _, _, sigma, *_, m, _, _, own = self._latent(v)
        return np.concatenate([mean[0], v[..., 1: self.k], (m + own) / sigma], axis=-1)

    def start(self) -> np.ndarray:
        u = self.post.start()
        u[..., 0] = 0.0
        return u

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bad = self.post.astray(v)
        if bad.any():
            v = np.where(bad[..., None], self.start(), v)
        (mu, scale, mu_by, scale_by), raw, phi, sigma, rho, (through, beside), s, (p_phi, p_sigma, s_phi, s_sigma), a, m, w, drive, own = self._latent(v)
        z = (m + own) / sigma
        like, g = self.post(np.concatenate([mu, v[..., 1: self.k], z], axis=-1))
        along = lambda a, b: np.vecdot(a, b)[..., None]
        gx = g[..., self.k:] / sigma
        back = s * through(gx, True)  # by e, and by w
        by_d = s * through(back)
        by_log_s = along(back, drive + w) + self.n
        by_p = (along(back[..., 1:], own[..., :-1]) + along(by_d[..., :-1], w[..., 1:])) / s
        by_sigma = by_p * p_sigma + by_log_s * s_sigma
        by_mu = g[..., :1] - self.c * by_d.sum(axis=-1, keepdims=True)
        by_phi = by_p * p_phi + by_log_s * s_phi + by_mu * mu_by[0] + scale_by[0]
        grad = g
        grad[..., self.k:] = back
        grad[..., :1] = scale * by_mu
        grad[..., 2:3] += by_sigma - along(gx, z) * sigma - self.n + by_mu * mu_by[1] + scale_by[1]
        if self.post.lever:
            by_m = gx - self.c * by_d
            own_rho = along(by_m, a) * sigma
            by_phi = by_phi + along(beside(by_m, True)[..., 1:], m[..., :-1])
            grad[..., 2:3] += own_rho * rho
            grad[..., self.k - 1: self.k] += (1 - rho * rho) * own_rho - rho * by_sigma
        grad[..., 1:2] += by_phi * 2 * raw * (1 - raw)
        volume = self.n * np.log(s / sigma) + np.log(scale)
        return np.where(bad | ~np.isfinite(like), -np.inf, like + volume[..., 0]), grad


#: Variances that the sampler starts from, of mu, logit, log sigma, log nu, atanh rho.
_FIRST = {"mu": 1.0, "phi": 0.5, "sigma": 0.15, "nu": 0.3, "rho": 0.1}


def sample(r: np.ndarray, variant: str, seeds: list[int], s: Sampler = Sampler()) -> list[dict[str, np.ndarray]]:
    """Draws of mu, phi, sigma, nu, rho and the last latent log variance, of each
    window (a row of r) from its seed. Their chains run side by side, but each
    draws as it would alone."""
    post = Posterior(r, variant, s.priors)
    white, names = Whitened(post), ("mu", "phi", "sigma", "nu", "rho", "h_last")
    first, start = np.array([_FIRST[n] for n in _names(variant)]), white.start()
    runs = [nuts.chain(x, first, np.random.default_rng(k), s.draws, s.tune, s.accept, s.most_depth, s.thin) for x, k in zip(start, seeds)]
    out = []
    for i, states in enumerate(nuts.side_by_side(runs, lambda v, which: white.rows(which)(v))):
        one = white.rows([i])
        u = np.array([one.to_posterior(v[None])[0] for v in states])
        mu, _, phi, sigma, nu, rho, z = post.parts(u)
        out.append({n: x[:, 0] for n, x in zip(names, (mu, phi, sigma, nu, rho, mu + sigma * z[:, -1:]))})
    return out


def fitted_all(windows: list[np.ndarray], variant: str, seeds: list[int], s: Sampler) -> list[tuple[dict[str, np.ndarray], bool, float, float] | None]:
    """For each window of demeaned returns, all of one length, (draws of all
    chains, converged, largest R-hat, least effective size); None where they do
    not vary or nothing finite comes out."""
    out: list = [None] * len(windows)
    able = [i for i, x in enumerate(windows) if len(x) > 1 and x.std() > 0]
    if not able:
        return out
    made = sample(np.array([windows[i] for i in able for _ in range(s.chains)]), variant, [seeds[i] + 7919 * k for i in able for k in range(s.chains)], s)
    for j, i in enumerate(able):
        got = made[j * s.chains: (j + 1) * s.chains]
        draws = {n: np.concatenate([c[n] for c in got]) for n in got[0]}
        if all(np.isfinite(v).all() for v in draws.values()):
            rhat = max(chains.rhat(*(c[n] for c in got)) for n in _names(variant))
            size = min(chains.effective_size(*(c[n] for c in got)) for n in _names(variant))
            out[i] = draws, bool(size > 200 if s.chains == 1 else rhat < 1.01 and size > 400), rhat, size
    return out


def fitted(x: np.ndarray, variant: str, seed: int, s: Sampler):
    """fitted_all() of one window."""
    return fitted_all([x], variant, [seed], s)[0]


def var_es(draws: dict[str, np.ndarray], variant: str, mean: float, alphas: tuple[float, ...], seed: int, use_rho: bool = False) -> dict[float, tuple[float, float]]:
    """VaR and ES of the next return, a simulated return a draw."""
    rng = np.random.default_rng(seed)
    heavy, _ = VARIANTS[variant]
    shock = rng.standard_normal(len(draws["mu"]))
    h = draws["mu"] + draws["phi"] * (draws["h_last"] - draws["mu"]) + draws["sigma"] * shock
    unit = rng.standard_t(draws["nu"]) if heavy else rng.standard_normal(len(h))
    if use_rho:
        unit = draws["rho"] * shock + np.sqrt(1 - draws["rho"] ** 2) * unit
    r = unit * np.exp(h / 2) + mean
    out = {}
    for a in alphas:
        q = np.quantile(r, a)
        below = r[r < q]
        out[a] = (-float(q), -float(below.mean()) if len(below) else -float(q))
    return out


def _names(variant: str) -> list[str]:
    heavy, lever = VARIANTS[variant]
    return ["mu", "phi", "sigma"] + ["nu"] * heavy + ["rho"] * lever


#: Refits of a series whose chains run side by side in one group.
TOGETHER = 16


def _spans(returns: DataFrame, c: Config) -> DataFrame:
    """A block for TOGETHER regular refits in a row: the window before the first
    and the days that they serve."""
    return blocked(returns, c.window, c.window + 1, TOGETHER * c.refit_every)


_TRIED = "series_id string, first int, block long, fit_t int, converged boolean, max_rhat double, min_ess double, figures array<struct<alpha:double,var:double,es:double>>"


def _tried(returns: DataFrame, due: DataFrame, variant: str, c: Config, s: Sampler) -> DataFrame:
    """A row for each span of refit_every days from a series' due day on: first,
    its first day, and fit_t, the first of its days on which a fit succeeds (null:
    none), with what that fit gives. Spans are fitted side by side."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        ret, day, days = pdf["ret"].to_numpy(), pdf["day"].tolist(), np.flatnonzero(pdf["target"].to_numpy()).tolist()
        spans, k = [days[k: k + c.refit_every] for k in range(0, len(days), c.refit_every)], int(pdf["block"][0]) * TOGETHER
        if pdf["left"].notna().any():
            spans = spans[: max(0, int(pdf["left"][0]) - k)]
        window = lambda i: ret[i - c.window: i]
        tries, fits = [0] * len(spans), [None] * len(spans)
        while open_ := [j for j, span in enumerate(spans) if fits[j] is None and tries[j] < len(span)]:
            at = [spans[j][tries[j]] for j in open_]
            got = fitted_all([window(i) - window(i).mean() for i in at], variant, [c.seed + day[i] - c.window - 1 for i in at], s)
            for j, fit in zip(open_, got):
                fits[j], tries[j] = fit, tries[j] + (fit is None)
        out = []
        for j, (span, fit) in enumerate(zip(spans, fits)):
            row = (pdf["series_id"][0], day[span[0]], k + j)
            if fit is None:
                out.append((*row, None, False, None, None, None))
            else:
                i = span[tries[j]]
                figures = var_es(fit[0], variant, float(window(i).mean()), c.alphas, c.seed, s.use_rho)
                out.append((*row, day[i], *fit[1:], [{"alpha": a, "var": v, "es": e} for a, (v, e) in figures.items()]))
        return pd.DataFrame(out, columns=["series_id", "first", "block", "fit_t", "converged", "max_rhat", "min_ess", "figures"]).astype({"fit_t": "Int32"})

    # days are counted so that the due one is the first after a window
    rows = returns.select("series_id", "t", "ret").join(due, "series_id").withColumn("day", F.col("t")).withColumn("t", F.col("t") - F.col("due") + c.window + 1)
    rows = _spans(rows, c).where(f"left is null or block * {TOGETHER} < left")
    return dealt(rows).applyInPandas(one, _TRIED)


def refits(returns: DataFrame, variant: str, c: Config, s: Sampler = Sampler(), due: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """The spans of the schedule, written: (series_id, first, fit_t, converged,
    max_rhat, min_ess, figures). From fit_t the figures hold for c.refit_every
    days, then the next fit is due; before it, back to first, days have failed.

    A fit that fails (a window without variance) is tried again the next day, and
    all later refits of its series move with it. All spans are fitted side by side
    as if none failed; what comes after a series' first moved fit is then made
    anew from there, for that series alone, until none moves: the state that goes
    from round to round is a row a series. due: (series_id, due), the day that
    each series' next fit is due; by default the first with a window before it.
    most: how many spans of a series are made.
    """
    Posterior(np.zeros(2), variant)  # is there such a variant?
    if due is None:
        due = returns.select("series_id").distinct().withColumn("due", F.lit(c.window + 1))
    due, kept = due.select("series_id", "due", F.lit(most).cast("long").alias("left")), []
    while True:
        got = store.staged(_tried(returns, due, variant, c, s), "refits")
        moved = got.where("fit_t > first").groupBy("series_id").agg(F.min("first").alias("cut"), F.min_by("fit_t", "first").alias("at"), F.min_by("block", "first").alias("k"))
        moved = store.staged(moved.join(due.select("series_id", "left"), "series_id"), "moved")
        kept.append(got.join(moved.select("series_id", "cut"), "series_id", "left").where("cut is null or first <= cut").drop("cut", "block"))
        due = moved.select("series_id", (F.col("at") + c.refit_every).alias("due"), (F.col("left") - F.col("k") - 1).alias("left")).where("left is null or left > 0")
        if due.isEmpty():
            return functools.reduce(DataFrame.unionByName, kept)


def next_due(spans: DataFrame, c: Config) -> DataFrame:
    """(series_id, due) after refits()."""
    return spans.groupBy("series_id").agg((F.max(F.coalesce("fit_t", "first")) + c.refit_every).alias("due"))


def served(returns: DataFrame, spans: DataFrame, variant: str, c: Config) -> DataFrame:
    """Long forecasts of the days of refits(), with converged, max_rhat and
    min_ess of the fit they use; fits that did not converge are used and say so."""
    last = F.coalesce("fit_t", "first") + F.lit(c.refit_every - 1)
    none = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(None).cast("double").alias("var"), F.lit(None).cast("double").alias("es")) for a in c.alphas))
    days = spans.select("*", F.explode(F.sequence("first", last)).alias("t")).withColumn("failed", F.col("fit_t").isNull() | (F.col("t") < F.col("fit_t")))
    good = lambda x: F.when(~F.col("failed"), x)
    days = days.select(
        "series_id", "t", F.col("failed").alias("estimation_failed"), (F.col("converged") & ~F.col("failed")).alias("converged"), good(F.col("max_rhat")).alias("max_rhat"),
        good(F.col("min_ess")).alias("min_ess"), F.inline(F.when(F.col("failed"), none).otherwise(F.col("figures"))),
    )
    r = returns.select("series_id", "date", "t", F.col("ret").alias("actual_return"))
    return r.join(days, ["series_id", "t"]).withColumn("model", F.lit(variant)).select(*FORECAST, "converged", "max_rhat", "min_ess")


def forecasts(returns: DataFrame, variant: str, c: Config, s: Sampler = Sampler()) -> DataFrame:
    """Long forecasts of every day that has a window before it, by refits() every
    c.refit_every days; the fit of a day starts from the seed c.seed + its place."""
    r = store.staged(returns.select("series_id", "date", "t", "ret"), "returns")
    return served(r, refits(r, variant, c, s), variant, c)


def long_draws(draws: DataFrame, parameters: tuple[str, ...]) -> DataFrame:
    """posterior() with a row for each parameter: (..., parameter, value)."""
    each = F.array(*(F.struct(F.lit(p).alias("parameter"), F.col(p).alias("value")) for p in parameters))
    return draws.select("series_id", "variant", "refit_t", "draw", F.inline(each))


def posterior(returns: DataFrame, variant: str, c: Config, s: Sampler = Sampler()) -> DataFrame:
    """(series_id, variant, refit_t, draw, mu, phi, sigma, nu, rho, h_last),
    written: who reads it twice does not sample twice."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").reset_index(drop=True)
        ret, t, days = pdf["ret"].to_numpy(), pdf["t"].tolist(), np.flatnonzero(pdf["target"].to_numpy()).tolist()[:: c.refit_every]
        windows = [ret[i - c.window: i] for i in days]
        names = ["series_id", "variant", "refit_t", "draw", "mu", "phi", "sigma", "nu", "rho", "h_last"]
        got = fitted_all([x - x.mean() for x in windows], variant, [c.seed + t[i] - c.window - 1 for i in days], s)
        parts = [pd.DataFrame({"series_id": pdf["series_id"][0], "variant": variant, "refit_t": t[i], "draw": range(len(d[0]["mu"])), **d[0]}) for i, d in zip(days, got) if d]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)

    schema = "series_id string, variant string, refit_t int, draw int, mu double, phi double, sigma double, nu double, rho double, h_last double"
    return store.staged(dealt(_spans(returns.select("series_id", "t", "ret"), c)).applyInPandas(one, schema), "posterior")
