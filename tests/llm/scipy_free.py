"""Digamma from its recurrence and a long asymptotic series, for comparison."""

import numpy as np


def digamma(x):
    x = np.asarray(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(30):
        out -= 1 / x
        x = x + 1
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)
