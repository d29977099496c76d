"""No-U-Turn sampling: a trajectory doubles until it turns back, a state of it is
chosen by weight, and step and metric adapt while tuning.

A chain is a generator that asks for the density at one point after another, so
that the points of many chains can be evaluated at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator
from dataclasses import dataclass

import numpy as np

Density = Callable[[np.ndarray], tuple[float, np.ndarray]]
#: Yields points, gets (log density, gradient), returns T.
Asking = Generator[np.ndarray, tuple[float, np.ndarray]]


class Metric:
    """The inverse mass: the covariance of the first k coordinates as a whole and
    the variances of the others, from the draws since the last renewal."""

    def __init__(self, n: int, k: int, first: np.ndarray):
        self.k, self.cov, self.var = k, np.diag(first), np.ones(n - k)
        self._renewed()

    def _renewed(self) -> None:
        self.root = np.linalg.cholesky(np.linalg.inv(self.cov))
        self.scale = np.concatenate([np.ones(self.k), self.var])
        self.inv_sd = 1 / np.sqrt(self.scale)
        self.seen, self.mean, self.m2 = 0, np.zeros(self.k + len(self.var)), np.zeros(len(self.var))
        self.m2k = np.zeros((self.k, self.k))

    def momentum(self, rng: np.random.Generator) -> np.ndarray:
        p = rng.standard_normal(self.k + len(self.var)) * self.inv_sd
        p[: self.k] = self.root @ p[: self.k]
        return p

    def velocity(self, p: np.ndarray) -> np.ndarray:
        v = self.scale * p
        v[: self.k] = self.cov @ p[: self.k]
        return v

    def add(self, x: np.ndarray) -> None:
        self.seen += 1
        d = x - self.mean
        self.mean += d / self.seen
        e = x - self.mean
        self.m2 += (d * e)[self.k:]
        self.m2k += np.outer(d[: self.k], e[: self.k])

    def renew(self) -> None:
        """From what was added, shrunk a little towards what it was."""
        n = self.seen
        if n > 2 * self.k:
            self.cov = (n * self.m2k / (n - 1) + 5 * 1e-2 * np.eye(self.k)) / (n + 5)
            self.var = (n * self.m2 / (n - 1) + 5.0) / (n + 5)
        self._renewed()


class StepSize:
    """Dual averaging towards a mean acceptance."""

    def __init__(self, start: float, accept: float):
        self.accept = accept
        self.restart(start)

    def restart(self, size: float) -> None:
        self.size, self.centre, self.count, self.error, self.smooth = size, math.log(10 * size), 0, 0.0, 0.0

    def learn(self, accepted: float) -> None:
        self.count += 1
        self.error += (self.accept - accepted - self.error) / (self.count + 10)
        x = self.centre - math.sqrt(self.count) / 0.05 * self.error
        share = self.count**-0.75
        self.smooth = share * x + (1 - share) * self.smooth
        self.size = math.exp(x)

    def settle(self) -> None:
        self.size = math.exp(self.smooth)


@dataclass
class _Tree:
    """A trajectory: its two ends as (x, gradient, momentum, velocity), the state
    chosen in it, the log of its weight, the sum of its momenta, and how it went."""

    left: tuple
    right: tuple
    chosen: tuple
    weight: float
    momenta: np.ndarray
    going: bool
    accepted: float
    steps: int


def _straight(momenta: np.ndarray, a: tuple, b: tuple) -> bool:
    return float(momenta @ a[3]) > 0 and float(momenta @ b[3]) > 0


def _joined(old: _Tree, new: _Tree, forward: bool, rng: np.random.Generator, biased: bool) -> _Tree:
    """Both as one. The state of the new half is taken by its share of the
    weight, or (biased, at the top) by the quotient of the two."""
    a, b = (old, new) if forward else (new, old)
    weight, momenta = float(np.logaddexp(old.weight, new.weight)), old.momenta + new.momenta
    take = new.going and math.log(max(rng.random(), 1e-300)) < new.weight - (old.weight if biased else weight)
    going = new.going and _straight(momenta, a.left, b.right) and _straight(a.momenta + b.left[2], a.left, b.left) and _straight(b.momenta + a.right[2], a.right, b.right)
    return _Tree(a.left, b.right, new.chosen if take else old.chosen, weight, momenta, going, old.accepted + new.accepted, old.steps + new.steps)


def transition(x: np.ndarray, like: float, grad: np.ndarray, size: float, m: Metric, rng: np.random.Generator, most_depth: int) -> Asking:
    """Returns ((x, like, grad) of the next draw, mean acceptance, steps)."""
    p = m.momentum(rng)
    v = m.velocity(p)
    energy = like - 0.5 * float(p @ v)

    def leaf(end: tuple, sign: int) -> Asking:
        y, g, q, _ = end
        q = q + 0.5 * sign * size * g
        y = y + sign * size * m.velocity(q)
        value, g = yield y
        q = q + 0.5 * sign * size * g
        v = m.velocity(q)
        gain = value - 0.5 * float(q @ v) - energy
        if not math.isfinite(gain):
            gain = -math.inf
        end = (y, g, q, v)
        return _Tree(end, end, (y, value, g), gain, q, gain > -1000, math.exp(min(0.0, gain)), 1)

    def grown(end: tuple, sign: int, depth: int) -> Asking:
        if not depth:
            return (yield from leaf(end, sign))
        half = yield from grown(end, sign, depth - 1)
        if not half.going:
            return half
        other = yield from grown(half.right if sign > 0 else half.left, sign, depth - 1)
        return _joined(half, other, sign > 0, rng, False)

    end = (x, grad, p, v)
    tree = _Tree(end, end, (x, like, grad), 0.0, p, True, 0.0, 0)
    for depth in range(most_depth):
        forward = rng.random() < 0.5
        new = yield from grown(tree.right if forward else tree.left, 1 if forward else -1, depth)
        tree = _joined(tree, new, forward, rng, True)
        if not tree.going:
            break
    return tree.chosen, tree.accepted / max(1, tree.steps), tree.steps


def chain(x: np.ndarray, first: np.ndarray, rng: np.random.Generator, n: int, tune: int, accept: float = 0.8, most_depth: int = 10, thin: int = 1) -> Asking:
    """Returns n states after tune; first: variances of the coordinates that
    share a covariance (the rest start at 1). The metric is renewed at the ends of
    windows that double."""
    like, grad = yield x
    m, step = Metric(len(x), len(first), first), StepSize(0.1, accept)
    begin, width = max(10, tune // 8), max(10, tune // 16)
    renew, kept = [], []
    while begin + 2 * width <= tune * 9 // 10:
        begin, width = begin + width, 2 * width
        renew.append(begin)
    renew.append(tune * 9 // 10)
    for i in range(tune):
        (x, like, grad), accepted, _ = yield from transition(x, like, grad, step.size, m, rng, most_depth)
        step.learn(accepted)
        if i >= tune // 8:
            m.add(x)
        if i + 1 in renew:
            m.renew()
            step.restart(step.size)
    if tune:
        step.settle()
    for i in range(n * thin):
        (x, like, grad), _, _ = yield from transition(x, like, grad, step.size, m, rng, most_depth)
        if i % thin == thin - 1:
            kept.append(x)
    return kept


def answered(asking: Asking, f: Density):
    """What one chain or transition returns."""
    try:
        x = next(asking)
        while True:
            x = asking.send(f(x))
    except StopIteration as e:
        return e.value


def side_by_side(chains: list[Asking], f: Callable[[np.ndarray, list[int]], tuple[np.ndarray, np.ndarray]]) -> list:
    """What many chains return; f(points, which) evaluates those that still ask,
    a row each."""
    out: list = [None] * len(chains)
    asks = {i: next(c) for i, c in enumerate(chains)}
    while asks:
        which = list(asks)
        like, grad = f(np.array([asks[i] for i in which]), which)
        for i, value, g in zip(which, like.tolist(), grad):
            try:
                asks[i] = chains[i].send((value, g))
            except StopIteration as e:
                out[i] = e.value
                del asks[i]
    return out
