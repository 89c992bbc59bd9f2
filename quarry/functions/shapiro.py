"""Shapiro-Wilk W and p (Royston's approximation, AS R94) in NumPy.

Runs inside ``applyInPandas`` on one group's bounded sample (<= 5,000 values),
never on a whole column.
"""

from __future__ import annotations

import math

import numpy as np

from .dist import norm_ppf, norm_sf

# fixed polynomial coefficients of Royston's approximation
C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
G = [-2.273, 0.459]
C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(values) -> tuple[float | None, float | None]:
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or np.ptp(x) == 0:
        return None, None
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
        w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
        w = max(w, 0.75)
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, min(1.0, p))
    m = np.array([norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float((m * m).sum())
    u = 1.0 / math.sqrt(n)
    a = np.zeros(n)
    an = m[-1] / math.sqrt(mm) + _poly(C1, u)
    if n > 5:
        an1 = m[-2] / math.sqrt(mm) + _poly(C2, u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        a[2:n - 2] = m[2:n - 2] / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
        a[1:n - 1] = m[1:n - 1] / math.sqrt(phi)
        a[-1], a[0] = an, -an
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n <= 11:
        gamma = _poly(G, n)
        if w >= 1.0 or math.log1p(-w) >= gamma:
            return w, 1.0 if w >= 1.0 else 0.0
        z = (-math.log(gamma - math.log1p(-w)) - _poly(C3, n)) / math.exp(_poly(C4, n))
    else:
        ln = math.log(n)
        if w >= 1.0:
            return w, 1.0
        z = (math.log1p(-w) - _poly(C5, ln)) / math.exp(_poly(C6, ln))
    return w, float(norm_sf(z))
