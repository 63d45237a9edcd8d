"""Order statistics of sliding windows: ranks and quantiles in a step for each bit of the number of values, not for each value of the window."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """A wavelet matrix: for each bit of the values' ranks, from the highest down, how many zeros stand before each place.

    Values with a zero move to the front of the next level, in order, the others behind them; a stretch of
    places stays two stretches on every level. All queries are arrays, answered together.
    """

    def __init__(self, values: np.ndarray):
        self.sorted, ranks = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.sorted) - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            zero = (ranks >> bit) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def _split(self, level: int, a: np.ndarray, b: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(zeros in the stretch, its places on the next level: those of ones where ``up``)."""
        z = self.zeros[level]
        za, zb = z[a], z[b]
        return zb - za, np.where(up, z[-1] + a - za, za), np.where(up, z[-1] + b - zb, zb)

    def below(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values at places a to b (exclusive) have a rank below ``limit``."""
        n, whole = np.zeros(len(a), np.int64), limit >= 1 << self.bits
        size = b - a
        for level in range(self.bits):
            up = (limit >> (self.bits - 1 - level)) & 1 == 1
            zeros, a, b = self._split(level, a, b, up)
            n += np.where(up, zeros, 0)
        return np.where(whole, size, n)

    def smallest(self, a: np.ndarray, b: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) at places a to b (exclusive)."""
        rank = np.zeros(len(a), np.int64)
        for level in range(self.bits):
            z = self.zeros[level]
            zeros = z[b] - z[a]
            up = k >= zeros
            k = np.where(up, k - zeros, k)
            _, a, b = self._split(level, a, b, up)
            rank |= up.astype(np.int64) << (self.bits - 1 - level)
        return self.sorted[rank]


def _filled(x: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose value and the ``before`` values ahead of it are all there, and x without gaps."""
    missing = np.concatenate([[0], np.cumsum(np.isnan(x))])
    at = np.arange(before, len(x))
    return at[missing[at + 1] == missing[at - before]], np.nan_to_num(x)


def sliding_rank(x: np.ndarray, lookback: int) -> np.ndarray:
    """Rank in percent of each value among the ``lookback`` before it; ties by the mean-rank rule, NaN where one is missing."""
    out = np.full(len(x), np.nan)
    at, values = _filled(x, lookback)
    if len(at):
        tree = Wavelet(values)
        rank = np.searchsorted(tree.sorted, values[at])
        less, upto = (tree.below(at - lookback, at, rank + more) for more in (0, 1))
        out[at] = (less + upto + (upto > less)) * 50.0 / lookback
    return out


def sliding_quantiles(x: np.ndarray, lookback: int, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Interpolated quantiles of the last ``lookback`` values, for each of ``shares``; NaN where one is missing."""
    at, values = _filled(x, lookback - 1)
    tree = Wavelet(values) if len(at) else None
    out = []
    for share in shares:
        place = share * (lookback - 1)
        low, high = int(np.floor(place)), int(np.ceil(place))
        found = np.full(len(x), np.nan)
        if tree is not None:
            a, b = (tree.smallest(at - lookback + 1, at + 1, np.full(len(at), k)) for k in (low, high))
            found[at] = a if low == high else (high - place) * a + (place - low) * b
        out.append(found)
    return out
