"""Dense least squares and unit-root tests that the declarative ones are held against."""

import math

import numpy as np


def ols(y, x, lags):
    """Coefficients, Newey-West errors, R2, adjusted R2 and AIC."""
    n, z = len(y), np.column_stack([np.ones(len(y)), x])
    k = z.shape[1]
    inv = np.linalg.inv(z.T @ z)
    b = inv @ z.T @ y
    e = y - z @ b
    s = sum(max(0, 1 - abs(i - j) / (lags + 1)) * e[i] * e[j] * np.outer(z[i], z[j]) for i in range(n) for j in range(max(0, i - lags), min(n, i + lags + 1)))
    r2 = 1 - e @ e / ((y - y.mean()) ** 2).sum()
    return b, np.sqrt(np.diag(inv @ s @ inv)), r2, 1 - (1 - r2) * (n - 1) / (n - k), n * math.log(2 * math.pi * (e @ e) / n) + n + 2 * k


def adf(y):
    """Statistic and lag order, by a fit of every order on the rows that all have."""
    d = np.diff(y)
    most = max(0, min(math.ceil(12 * (len(y) / 100) ** 0.25), len(d) // 2 - 2))

    def fit(p, skip):
        t = d[skip:]
        z = np.column_stack([np.ones(len(t)), y[skip:-1], *(d[skip - k : len(d) - k] for k in range(1, p + 1))])
        b = np.linalg.lstsq(z, t, rcond=None)[0]
        e = t - z @ b
        se = math.sqrt(e @ e / (len(t) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
        return len(t) * math.log(e @ e / len(t)) + 2 * z.shape[1], b[1] / se

    p = min(range(most + 1), key=lambda k: fit(k, most)[0])
    return fit(p, p)[1], p
