"""Order statistics and tail sums of a sliding window, in steps of its logarithm."""

from __future__ import annotations

import numpy as np


class SlidingOrder:
    """The values of a block that are in the window now, by rank.

    Two Fenwick trees over the ranks of all values of the block hold counts and
    sums; a value comes or goes in log(n), and one descent finds the k-th least
    with the sum of those before it. Equal values have ranks of their own;
    first_equal leads to the least of them.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        n = len(values)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ordered = values[order]
        self.rank = (rank + 1).tolist()
        self.value = [0.0, *ordered.tolist()]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
        self.first_equal = [0, *(np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1).tolist()]
        self.n, self.top = n, 1 << n.bit_length() - 1 if n else 0
        self.count, self.sum = [0] * (n + 1), [0.0] * (n + 1)

    def _move(self, i: int, by: int) -> None:
        at = self.rank[i]
        x, n, count, total = by * self.value[at], self.n, self.count, self.sum
        while at <= n:
            count[at] += by
            total[at] += x
            at += at & -at

    def add(self, i: int) -> None:
        """The i-th value of the block comes in."""
        self._move(i, 1)

    def drop(self, i: int) -> None:
        self._move(i, -1)

    def least(self, k: int) -> tuple[int, float]:
        """(rank of the k-th least from 0, sum of the k before it)."""
        at, step, total, count = 0, self.top, 0.0, self.count
        while step:
            nxt = at + step
            if nxt <= self.n and count[nxt] <= k:
                at, k, total = nxt, k - count[nxt], total + self.sum[nxt]
            step >>= 1
        return at + 1, total

    def upto(self, rank: int) -> tuple[int, float]:
        """How many are of lower rank, and their sum."""
        n, total, at = 0, 0.0, rank - 1
        while at:
            n, total, at = n + self.count[at], total + self.sum[at], at & (at - 1)
        return n, total

    def tail(self, k: int, share: float) -> tuple[float, int, float]:
        """(q, how many are strictly below it, their sum), q being the value
        share of the way from the k-th least to the next."""
        rank, before = self.least(k)
        low = self.value[rank]
        high = self.value[self.least(k + 1)[0]] if share else low
        q = low + share * (high - low)
        if q > low:
            return q, k + 1, before + low
        first = self.first_equal[rank]
        n, total = self.upto(first)
        return q, n, total


def rolling_tails(values: np.ndarray, window: int, alphas: tuple[float, ...]) -> np.ndarray:
    """For each value from number `window` on and each alpha (quantile, mean
    strictly below it or NaN) of the `window` values before it: an array (rows,
    alphas, 2)."""
    rows = len(values) - window
    out = np.full((max(0, rows), len(alphas), 2), np.nan)
    if rows <= 0:
        return out
    s = SlidingOrder(values)
    for i in range(window):
        s.add(i)
    places = [(int((window - 1) * a), (window - 1) * a - int((window - 1) * a)) for a in alphas]
    for r in range(rows):
        for j, (k, share) in enumerate(places):
            q, n, total = s.tail(k, share)
            out[r, j, 0] = q
            if n:
                out[r, j, 1] = total / n
        s.add(window + r)
        s.drop(r)
    return out
