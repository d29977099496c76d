"""Whether chains have mixed: rank-normalised split R-hat and effective size."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def halves(*chains: np.ndarray) -> np.ndarray:
    """The first and last halves of all chains as rows; of an odd number of draws
    the middle one goes."""
    h = len(chains[0]) // 2
    return np.array([part for c in chains for part in (c[:h], c[len(c) - h:])], float)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """From 1; equal values share the mean of their ranks."""
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse.reshape(-1)].reshape(x.shape)


def normal_scores(x: np.ndarray) -> np.ndarray:
    """Normal quantiles of the fractional ranks over all rows."""
    share = (average_ranks(x) - 0.375) / (x.size + 0.25)
    return np.array([_NORMAL.inv_cdf(p) for p in share.ravel()]).reshape(x.shape)


def plain_rhat(rows: np.ndarray) -> float:
    n = rows.shape[1]
    within = rows.var(axis=1, ddof=1).mean()
    between = n * rows.mean(axis=1).var(ddof=1)
    return float(math.sqrt(((n - 1) / n * within + between / n) / within)) if within > 0 else 1.0


def rhat(*chains: np.ndarray) -> float:
    """The larger of the R-hats of the scores and of the scores folded about the
    median, which sees chains that differ in spread."""
    rows = halves(*chains)
    folded = np.abs(rows - np.median(rows))
    return max(plain_rhat(normal_scores(rows)), plain_rhat(normal_scores(folded)))


def pooled_size(rows: np.ndarray) -> float:
    """Effective number of draws of all rows: autocovariances pooled over rows,
    summed in pairs as long as those are positive, each at most the one before."""
    m, n = rows.shape
    d = rows - rows.mean(axis=1, keepdims=True)
    f = np.fft.rfft(d, 2 * n, axis=1)
    cov = np.fft.irfft(f * np.conj(f), axis=1)[:, :n].mean(axis=0) / n
    within = cov[0] * n / (n - 1)
    total = cov[0] + (rows.mean(axis=1).var(ddof=1) if m > 1 else 0.0)
    if n < 4 or total <= 0:
        return float(m * n)
    rho = 1 - (within - cov) / total
    rho[0] = 1.0
    pairs = rho[0: n - n % 2: 2] + rho[1: n: 2]
    end = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs)
    pairs = np.minimum.accumulate(pairs[:end])
    rest = max(0.0, float(rho[2 * end])) if 2 * end < n else 0.0
    tau = max(-1 + 2 * float(pairs.sum()) + rest, 1 / math.log10(m * n))
    return float(m * n / tau)


def effective_size(*chains: np.ndarray) -> float:
    """Of the bulk: pooled_size() of the scores of half chains."""
    return pooled_size(normal_scores(halves(*chains)))
