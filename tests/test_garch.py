"""Volatility fits: scores against differences, integrated series, bounds, and
maxima against many random parameters."""

import numpy as np
import pytest

from tidemark.operators import garch

ORDERS = [("GARCH", 1, 1, 0), ("GARCH", 2, 1, 0), ("GARCH", 1, 2, 0), ("EGARCH", 1, 1, 0), ("EGARCH", 1, 1, 1), ("EGARCH", 2, 2, 1)]


def _simulated(seed, n, omega, a, b):
    rng, v, out = np.random.default_rng(seed), 1.0, []
    for _ in range(n):
        out.append(np.sqrt(v) * rng.standard_normal())
        v = omega + a * out[-1] ** 2 + b * v
    return np.array(out)


@pytest.mark.parametrize("kind,p,q,o", ORDERS)
def test_scores_are_derivatives(kind, p, q, o):
    x = np.array([_simulated(s, 120, 0.05, 0.1, 0.85) for s in range(3)])
    at = garch._begun(x, kind, p, q, o)[0][0]
    score = garch._recursion(x, garch._parts(at, p, o), kind, p, q, o, scores=True)[2].sum(0)
    for j in range(at.shape[1]):
        h = np.where(np.arange(at.shape[1]) == j, 1e-6, 0)
        up, down = (garch._recursion(x, garch._parts(at + d, p, o), kind, p, q, o)[0].sum(0) for d in (h, -h))
        assert score[j] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("kind,p,q,o", ORDERS)
def test_packing_keeps_the_likelihood(kind, p, q, o):
    x = np.array([_simulated(s, 90, 0.05, 0.1, 0.85) for s in range(3)])
    at = garch._begun(x, kind, p, q, o)[0][1]
    theta = garch._pack(at, kind, p, o)
    for one, other in zip(garch._unpack(theta, kind, p, q, o), garch._parts(at, p, o)):
        assert one == pytest.approx(other)


def test_integrated_series_are_not_bounded_below_one():
    x = np.array([_simulated(s, 2000, 0.02, 0.2, 0.8) for s in range(12)])
    theta, like, nxt, ended = garch.fit(x)
    _, _, a, _, b = garch._unpack(theta, "GARCH", 1, 1, 0)
    sums = (a + b)[:, 0]
    assert ended.all() and np.isfinite(nxt).all() and (sums <= garch._SUM).all()
    assert (sums >= 1).sum() >= 3 and abs(np.median(sums) - 1) < 0.02
    # a fit held below one is worse wherever the free one is above it
    for r in np.flatnonzero(sums > 1.002):
        nat = np.column_stack([u.reshape(1, -1) for u in (theta[r, :1], np.exp(theta[r, 1:2]), a[r] * 0.999 / sums[r], b[r] * 0.999 / sums[r])])
        assert garch._recursion(x[[r]], garch._parts(nat, 1, 0), "GARCH", 1, 1, 0)[0].sum() < like[r]


@pytest.mark.parametrize("kind,p,q,o", ORDERS)
def test_no_random_parameters_beat_the_fit(kind, p, q, o):
    rng = np.random.default_rng(1)
    x = _simulated(4, 600, 0.05, 0.1, 0.85)[None, :]
    theta, like, _, _ = garch.fit(x, kind, p, q, o)
    assert garch.filtered(x, theta, kind, p, q, o)[0].sum() == pytest.approx(like[0])
    tried = np.tile(theta, (400, 1)) + rng.normal(0, 1, (400, theta.shape[1])) * rng.choice([0.01, 0.1, 0.5], (400, 1))
    assert np.nanmax(garch.filtered(np.tile(x, (400, 1)), tried, kind, p, q, o)[0].sum(1)) < like[0] + 1e-3


def test_rows_do_not_meet():
    x = np.array([_simulated(s, 250, 0.05, 0.1, 0.85) for s in range(5)])
    x[3] *= 100
    for kind in ("GARCH", "EGARCH"):
        whole = garch.fit(x, kind)
        for r in range(5):
            alone = garch.fit(x[[r]], kind)
            assert alone[1][0] == pytest.approx(whole[1][r], rel=1e-9) and alone[2][0] == pytest.approx(whole[2][r], rel=1e-6)


def test_scale_is_carried_through():
    x = np.array([_simulated(9, 400, 0.05, 0.1, 0.85)])
    one, two = garch.fit(x), garch.fit(10 * x)
    assert two[2][0] == pytest.approx(100 * one[2][0], rel=1e-3)
    assert two[1][0] == pytest.approx(one[1][0] - 400 * np.log(10), abs=1e-2)


@pytest.mark.parametrize("kind", ["GARCH", "EGARCH"])
def test_a_batch_costs_no_digit(kind):
    """Rows fitted by fours, by twos or at once come out the same."""
    x = np.lib.stride_tricks.sliding_window_view(_simulated(3, 132, 0.05, 0.1, 0.85), 120)[:12]
    whole = garch.fit(np.ascontiguousarray(x), kind)[2]
    for rows in (2, 4):
        parts = [garch.fit(np.ascontiguousarray(x[k: k + rows]), kind)[2] for k in range(0, 12, rows)]
        assert np.concatenate(parts).tolist() == whole.tolist()
