"""Tail probabilities for result rows: normal, chi-square, Student's t, Kolmogorov and the exact ones of small samples, in plain Python on a few numbers each."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series below a + 1 and a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = step * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + step / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2) if dof > 0 else float("nan")


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def t_two_sided(t: float, dof: float) -> float:
    return beta_inc(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else float("nan")


def kolmogorov_sf(d: float, n: float, m: float) -> float:
    """The two-sample p-value by the limit distribution, whatever the sample sizes."""
    x = d * math.sqrt(n * m / (n + m))
    if x < 1e-6:
        return 1.0
    if x < 0.5:  # the theta-function form converges fast for small x
        q = math.exp(-(math.pi**2) / (8 * x * x))
        return max(0.0, min(1.0, 1 - math.sqrt(2 * math.pi) / x * sum(q ** ((2 * k - 1) ** 2) for k in range(1, 50))))
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


# Up to which sizes p-values are exact: the smaller sample of a rank sum without ties, the larger one of a distance of distributions.
EXACT_RANK_SUM, EXACT_DISTANCE = 8, 10_000
#: A rank sum's exact distribution is counted for up to so many values of U.
EXACT_COUNTS = 200_000


def rank_sum_counts(m: int, n: int) -> list[int]:
    """In how many ways each value of U, 0 to m n, comes about: the coefficients of the product of (1 - x^(n+i)) / (1 - x^i) for i of 1 to m."""
    size = m * n + 1
    ways = [1] + [0] * (size - 1)
    for i in range(1, m + 1):
        for u in range(size - 1, n + i - 1, -1):
            ways[u] -= ways[u - n - i]
        for u in range(i, size):
            ways[u] += ways[u - i]
    return ways


def rank_sum_two_sided(u: float, n0: float, n1: float, z: float, ties: float) -> float:
    """The two-sided p-value of a Mann-Whitney U: exact where a sample has at most ``EXACT_RANK_SUM`` rows and no two values are equal, else by the normal
    limit from ``z``. ``ties`` is zero if no values are equal."""
    m, n = int(min(n0, n1)), int(max(n0, n1))
    if m > EXACT_RANK_SUM or ties > 0 or m * n > EXACT_COUNTS:
        return normal_two_sided(z)
    ways, far = rank_sum_counts(m, n), int(max(u, n0 * n1 - u))
    return min(1.0, 2 * sum(ways[far:]) / math.comb(m + n, m))


def distance_sf(d: float, n0: float, n1: float) -> float:
    """The two-sided p-value of a Kolmogorov-Smirnov distance: exact for samples of up to ``EXACT_DISTANCE`` rows, else by the limit.

    All orders of the two samples are as likely; an order is a lattice path, and the p-value is the share of the paths that come as far from the diagonal as ``d``. Paths
    are taken step by step, all places of a step at once, and leave when they first come so far."""
    import numpy as np

    m, n = int(n0), int(n1)
    if max(m, n) > EXACT_DISTANCE:
        return kolmogorov_sf(d, n0, n1)
    unit = math.gcd(m, n)
    far = round(d * (m * n // unit)) * unit
    if far <= 0:
        return 1.0
    i = np.arange(m + 1, dtype=np.int64)
    here, gone = np.zeros(m + 1), 0.0
    here[0] = 1.0
    for k in range(m + n):
        up = here * np.maximum(m - i, 0) / (m + n - k)  # the next row is of the first sample
        here = here - up
        here[1:] += up[:-1]
        out = np.abs(i * n - (k + 1 - i) * m) >= far
        gone += here[out].sum()
        here[out] = 0.0
    return min(1.0, float(gone))
