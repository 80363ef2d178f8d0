"""Tail probabilities of the t and F distributions by the incomplete beta function, and least squares."""

from __future__ import annotations

import math

import numpy as np


def beta_ratio(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_ratio(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for k in range(400):
        m = k // 2
        term = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or tiny)
        c = 1 + term / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_tail(t: float, dof: float) -> float:
    """P(T > t)."""
    half = 0.5 * beta_ratio(dof / 2, 0.5, dof / (dof + t * t))
    return half if t >= 0 else 1 - half


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return beta_ratio(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def least_squares(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Coefficients, residuals, residual and regression sums of squares, and the covariance of the coefficients, for each column of y."""
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    fit = x @ b
    resid = y - fit
    sse, ssr = (resid**2).sum(axis=0), ((fit - y.mean(axis=0)) ** 2).sum(axis=0)
    inverse = np.linalg.pinv(x.T @ x)
    return {"b": b, "resid": resid, "sse": sse, "ssr": ssr, "cov": inverse[:, :, None] * (sse / (len(x) - x.shape[1]))}
