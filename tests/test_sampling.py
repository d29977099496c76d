"""The No-U-Turn sampler, the stochastic-volatility posteriors, and chain figures."""

import math

import numpy as np
import pytest

from tidemark.operators import chains, nuts, sv

TRUE = {"mu": -9.0, "phi": 0.95, "sigma": 0.25, "nu": 8.0, "rho": -0.4}


def simulated(n, variant, seed):
    rng, (heavy, lever) = np.random.default_rng(seed), sv.VARIANTS[variant]
    step = rng.standard_normal(n)
    z = np.empty(n)
    z[0] = step[0] / math.sqrt(1 - TRUE["phi"] ** 2)
    for t in range(1, n):
        z[t] = TRUE["phi"] * z[t - 1] + step[t]
    unit = rng.standard_t(TRUE["nu"], n) if heavy else rng.standard_normal(n)
    if lever:
        unit = TRUE["rho"] * step + math.sqrt(1 - TRUE["rho"] ** 2) * unit
    return np.exp((TRUE["mu"] + TRUE["sigma"] * z) / 2) * unit


def test_nuts_on_a_known_density():
    """A correlated normal with scales from 0.03 to 3."""
    rng = np.random.default_rng(1)
    scale = np.array([3.0, 1.0, 0.3, 0.03, 1.0])
    cov = np.diag(scale) @ (0.6 + 0.4 * np.eye(5)) @ np.diag(scale)
    inv, mean = np.linalg.inv(cov), np.array([5.0, -2.0, 0.0, 1.0, 100.0])

    def f(x):
        d = x - mean
        return -0.5 * float(d @ inv @ d), -inv @ d

    x = np.array(nuts.answered(nuts.chain(mean + 5 * scale, scale[:2] ** 2, rng, 4000, 1000), f))
    assert np.abs((x.mean(0) - mean) / scale).max() < 0.1
    assert np.abs(np.cov(x.T) / np.outer(scale, scale) - (0.6 + 0.4 * np.eye(5))).max() < 0.12
    assert min(chains.effective_size(x[:, i]) for i in range(5)) > 500


def test_a_trajectory_ends_where_it_turns():
    f = lambda x: (-0.5 * float(x @ x), -x)
    m = nuts.Metric(2, 1, np.ones(1))
    steps = [nuts.answered(nuts.transition(np.ones(2), *f(np.ones(2)), 0.1, m, np.random.default_rng(i), 10), f)[2] for i in range(50)]
    assert 15 <= np.median(steps) <= 63  # half a turn is 31 steps of 0.1
    wall = lambda x: (-math.inf, np.zeros(2)) if x[0] > 1.5 else f(x)
    for i in range(50):
        (x, _, _), _, _ = nuts.answered(nuts.transition(np.ones(2), *f(np.ones(2)), 0.3, m, np.random.default_rng(i), 10), wall)
        assert x[0] <= 1.5


@pytest.mark.parametrize("variant", list(sv.VARIANTS))
def test_whitened_gradient_and_volume(variant):
    post = sv.Posterior(simulated(14, variant, 1), variant)
    w = sv.Whitened(post)
    v = w.start() + 0.4 * np.random.default_rng(2).standard_normal(post.k + 14)
    _, g = w(v)
    jac = np.empty((len(v), len(v)))
    for i in range(len(v)):
        d = 1e-5 * (np.arange(len(v)) == i)
        assert g[i] == pytest.approx((w(v + d)[0] - w(v - d)[0]) / 2e-5, rel=1e-5, abs=1e-5)
        jac[:, i] = (w.to_posterior(v + d) - w.to_posterior(v - d)) / 2e-5
    volume = np.linalg.slogdet(jac)[1]
    assert w(v)[0] == pytest.approx(post(w.to_posterior(v))[0] + volume, abs=1e-6)


def test_filters_agree():
    x = np.random.default_rng(3).standard_normal((5, 700))
    phi = np.array([[0.0], [0.3], [-0.8], [0.97], [0.9999]])
    want, back = x.copy(), x.copy()
    for t in range(1, 700):
        want[:, t] += phi[:, 0] * want[:, t - 1]
        back[:, 699 - t] += phi[:, 0] * back[:, 700 - t]
    assert np.allclose(sv._filtered(x, phi), want, atol=1e-6) and np.allclose(sv._filtered(x, phi, True), back, atol=1e-6)


def test_filters_reach_to_the_end():
    """What is left of a large value is as exact as what is near it."""
    for n in (1, 2, 17, 250, 256):
        x, phi = np.zeros((2, n)), np.array([[0.9], [-0.8]])
        x[:, 0] = 1e12
        want = 1e12 * phi ** np.arange(n)
        assert np.allclose(sv._filtered(x, phi), want, rtol=1e-11, atol=0)
        assert np.allclose(sv._filtered(x[:, ::-1], phi, True), want[:, ::-1], rtol=1e-11, atol=0)


@pytest.mark.parametrize("variant", list(sv.VARIANTS))
def test_windows_side_by_side(variant):
    """Many windows at once are as each alone, steps gone astray included."""
    r = np.array([simulated(40, variant, k) for k in range(4)])
    w = sv.Whitened(sv.Posterior(r, variant))
    v = w.start() + 0.3 * np.random.default_rng(6).standard_normal((4, w.k + 40))
    v[2, 1], v[3, 5] = 40.0, np.nan
    like, grad = w(v)
    assert like[2] == like[3] == -np.inf
    for i in range(4):
        one = sv.Whitened(sv.Posterior(r[i], variant))(v[i])
        assert like[i] == pytest.approx(float(one[0]), rel=1e-9)
        if i < 2:
            assert grad[i] == pytest.approx(one[1], rel=1e-6, abs=1e-6)
    s = sv.Sampler(10, 20, thin=1)
    both = sv.fitted_all([r[0], np.zeros(40), r[1]], variant, [1, 2, 3], s)
    assert both[1] is None
    alone = sv.fitted(r[1], variant, 3, s)
    assert all(np.allclose(both[2][0][n], alone[0][n], rtol=1e-3) for n in alone[0])


@pytest.mark.parametrize("variant", list(sv.VARIANTS))
def test_chains_mix_and_find_the_truth(variant):
    """Three simulated series of 250 days: least effective size over 200 and
    R-hat under 1.05 in all but one at most; phi and sigma lie within 95% in at
    least five of six cases."""
    mixed, inside = 0, 0
    series = [simulated(250, variant, seed) for seed in (10, 11, 12)]
    for draws, converged, rhat, size in sv.fitted_all([r - r.mean() for r in series], variant, [42] * 3, sv.Sampler()):
        assert converged == (size > 200) and rhat < 1.1
        mixed += size > 200 and rhat < 1.05
        inside += sum(np.quantile(draws[n], 0.025) <= TRUE[n] <= np.quantile(draws[n], 0.975) for n in ("phi", "sigma"))
    assert mixed >= 2 and inside >= 5


def test_ranks_and_scores():
    assert chains.average_ranks(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [4, 1.5, 1.5, 3]
    s = chains.normal_scores(np.array([[10.0, 30.0], [20.0, 40.0]]))
    assert s[0, 0] == -s[1, 1] == pytest.approx(-1.0491314) and s[1, 0] == -s[0, 1] == pytest.approx(-0.2993069)
    assert chains.halves(np.arange(5.0)).tolist() == [[0, 1], [3, 4]]


def test_rhat_by_hand():
    assert chains.plain_rhat(np.array([[0.0, 1.0], [0.0, 1.0]])) == pytest.approx(math.sqrt(0.5))
    # within 0.5, between 2 * 0.5: (0.25 + 0.5) / 0.5
    assert chains.plain_rhat(np.array([[0.0, 1.0], [1.0, 2.0]])) == pytest.approx(math.sqrt(1.5))
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal(1000), rng.standard_normal(1000)
    assert chains.rhat(a, b) < 1.01 < 1.3 < chains.rhat(a, b + 2)
    assert chains.rhat(a, 4 * b) > 1.1 > 1.02 > chains.plain_rhat(chains.normal_scores(chains.halves(a, 4 * b)))  # only the fold sees it
    assert chains.rhat(np.ones(10)) == 1.0
    assert chains.rhat(a**3 * 1e6, b**3 * 1e6) == pytest.approx(chains.rhat(a, b), abs=0.01)  # ranks alone count


def test_effective_size():
    rng = np.random.default_rng(5)
    white, slow, swing = rng.standard_normal((2, 4000)), np.empty((2, 4000)), np.empty((2, 4000))
    for out, phi in ((slow, 0.5), (swing, -0.5)):
        out[:, 0] = white[:, 0]
        for t in range(1, 4000):
            out[:, t] = phi * out[:, t - 1] + white[:, t]
    assert 6500 < chains.effective_size(*white) < 9500
    assert 2200 < chains.effective_size(*slow) < 3200  # a third
    assert chains.effective_size(*swing) > 15_000
    assert chains.effective_size(slow[0], slow[1] + 50) < 10  # chains apart
    assert chains.pooled_size(np.ones((1, 8))) == 8


def test_velocities_are_kept():
    """Two a step and one a trajectory; whether it has turned takes no more."""
    f, seen = lambda x: (-0.5 * float(x @ x), -x), []

    class Counting(nuts.Metric):
        def velocity(self, p):
            seen.append(1)
            return super().velocity(p)

    m = Counting(3, 1, np.ones(1))
    for i in range(20):
        seen.clear()
        steps = nuts.answered(nuts.transition(np.ones(3), *f(np.ones(3)), 0.1, m, np.random.default_rng(i), 10), f)[2]
        assert len(seen) == 2 * steps + 1
