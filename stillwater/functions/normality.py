"""Normality and exact rank tests: scalars of one row a test."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

# Royston's polynomials (algorithm AS R94), lowest power first.
#: Corrections of the two largest weights, in 1 / sqrt(n).
LAST = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
LAST_BUT_ONE = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
#: Mean and logarithm of the spread of the transformed statistic: up to 11 values in n, beyond in log n; GAMMA in n.
SMALL_MEAN, SMALL_SPREAD = (0.544, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SPREAD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
GAMMA = (-2.273, 0.459)

#: Numbers of values for which the approximation holds.
LEAST, MOST = 3, 5000


def _poly(c: tuple[float, ...], x: float) -> float:
    return sum(v * x**i for i, v in enumerate(c))


def score(i: float, n: float) -> float:
    """Expected place of the i-th of n ordered normal values (Blom)."""
    return NormalDist().inv_cdf((i - 0.375) / (n + 0.25))


def shapiro_w(n: int, sum_mx: float, sum_mm: float, ends: tuple[float, float, float, float], ss: float) -> float | None:
    """The W statistic from sums over a sample: of scores times ordered values, of squared scores, the two least and two largest values, and the squares about the mean.

    None outside of 3 to 5,000 values or for constant ones.
    """
    if not LEAST <= n <= MOST or not ss > 0:
        return None
    low, second, last_but_one, high = ends
    if n == 3:
        return min(1.0, (math.sqrt(0.5) * (high - low)) ** 2 / ss)
    u, norm = 1 / math.sqrt(n), math.sqrt(sum_mm)
    m1, m2 = score(n, n), score(n - 1, n)
    a1 = _poly(LAST, u) + m1 / norm
    rest = sum_mx - m1 * (high - low)
    if n > 5:
        a2 = _poly(LAST_BUT_ONE, u) + m2 / norm
        rest -= m2 * (last_but_one - second)
        scale = (sum_mm - 2 * m1**2 - 2 * m2**2) / (1 - 2 * a1**2 - 2 * a2**2)
        total = a1 * (high - low) + a2 * (last_but_one - second) + rest / math.sqrt(scale)
    else:
        scale = (sum_mm - 2 * m1**2) / (1 - 2 * a1**2)
        total = a1 * (high - low) + rest / math.sqrt(scale)
    return min(1.0, total**2 / ss)


def shapiro_p(w: float, n: int) -> float:
    """Upper tail of W: small values speak against a normal distribution."""
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y, log = math.log(1 - w), math.log(n)
    if n <= 11:
        gamma = _poly(GAMMA, n)
        if y >= gamma:
            return 0.0
        y, mean, spread = -math.log(gamma - y), _poly(SMALL_MEAN, n), math.exp(_poly(SMALL_SPREAD, n))
    else:
        mean, spread = _poly(LARGE_MEAN, log), math.exp(_poly(LARGE_SPREAD, log))
    return 0.5 * math.erfc((y - mean) / spread / math.sqrt(2))


#: Differences up to which signed ranks have an exact p value.
EXACT = 50


def signed_rank_p(n: int, w: float) -> float:
    """Exact two-sided p of the smaller signed-rank sum ``w`` of ``n`` untied differences.

    The null distribution counts the sets of ranks by their sum, rank by rank.
    """
    if not n:
        return 1.0
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for rank in range(1, n + 1):
        ways[rank:] += ways[:-rank].copy()
    return min(1.0, 2 * float(ways[: int(w) + 1].sum()) / 2.0**n)


def signed_rank_normal(n: int, w: float, ties: float) -> float:
    """Two-sided p by the normal approximation; ``ties`` is the sum of t^3 - t over groups of tied differences."""
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(spread) / math.sqrt(2)) if spread > 0 else 1.0
