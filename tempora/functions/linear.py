"""Least squares and covariance estimates on arrays."""

from __future__ import annotations

import math

import numpy as np


def ols(y: np.ndarray, x: np.ndarray):
    """(beta, residuals, inverse of X'X) by QR."""
    q, r = np.linalg.qr(x)
    if np.abs(np.diag(r)).min() <= 1e-12 * max(np.abs(np.diag(r)).max(), 1e-300):
        raise ValueError("the regressors are collinear: a column is a combination of others")
    ri = np.linalg.inv(r)
    beta = ri @ (q.T @ y)
    return beta, y - x @ beta, ri @ ri.T


def rss(y: np.ndarray, x: np.ndarray) -> float:
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    u = y - x @ b
    return float(u @ u)


def llf(ssr: float, n: int) -> float:
    return -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)


def bartlett(j: np.ndarray | int, lags: float):
    return np.maximum(1 - np.asarray(j) / (lags + 1), 0)


def kernel_weight(kernel: str, j: int, bandwidth: float) -> float:
    if kernel == "bartlett":
        return float(max(1 - j / (bandwidth + 1), 0))
    if kernel == "truncated":
        return float(j <= bandwidth)
    if kernel == "parzen":
        z = j / (bandwidth + 1)
        return 1 - 6 * z**2 + 6 * z**3 if z <= 0.5 else 2 * (1 - z) ** 3 if z <= 1 else 0.0
    if kernel in ("qs", "quadratic_spectral"):
        if bandwidth == 0:
            return 0.0
        z = 6 * math.pi * (j / bandwidth) / 5
        return 25 / (12 * math.pi**2 * (j / bandwidth) ** 2) * (math.sin(z) / z - math.cos(z)) if j else 1.0
    raise ValueError(f"kernel {kernel!r}: bartlett, parzen, qs or truncated")


def autocov(x: np.ndarray, lags: int) -> np.ndarray:
    """About zero, over n."""
    n = len(x)
    return np.array([x[k:] @ x[: n - k] / n for k in range(min(lags, n - 1) + 1)])


def lrv(x: np.ndarray, kernel: str = "bartlett", bandwidth: float | None = None) -> float:
    n = len(x)
    b = math.floor(4 * (n / 100) ** (2 / 9)) if bandwidth is None else bandwidth
    lags = n - 1 if kernel in ("qs", "quadratic_spectral") else min(int(b), n - 1)
    g = autocov(x, lags)
    return float(g[0] + 2 * sum(kernel_weight(kernel, j, b) * g[j] for j in range(1, lags + 1)))


def meat(scores: np.ndarray, lags: int) -> np.ndarray:
    """Bartlett sum of score products, not divided."""
    s = scores.T @ scores
    for j in range(1, lags + 1):
        g = scores[j:].T @ scores[:-j]
        s = s + (1 - j / (lags + 1)) * (g + g.T)
    return s


def covariance(x: np.ndarray, u: np.ndarray, inv: np.ndarray, se_type: str = "hac", maxlags: int | None = None, correction: bool = True) -> np.ndarray:
    n, k = x.shape
    if se_type == "nonrobust":
        return inv * (u @ u) / (n - k)
    if se_type == "hac":
        lags = math.floor(4 * (n / 100) ** (2 / 9)) if maxlags is None else maxlags
        out = inv @ meat(x * u[:, None], lags) @ inv
        return out * n / (n - k) if correction else out
    w = u**2
    if se_type in ("hc2", "hc3"):
        h = np.einsum("ij,jk,ik->i", x, inv, x)
        w = w / np.maximum(1 - h, 1e-12) ** (1 if se_type == "hc2" else 2)
    elif se_type not in ("hc0", "hc1"):
        raise ValueError(f"se_type {se_type!r}: nonrobust, hc0, hc1, hc2, hc3 or hac")
    out = inv @ (x.T @ (x * w[:, None])) @ inv
    return out * n / (n - k) if se_type == "hc1" else out


def lagmat(y: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns y_{t-1}..y_{t-lags} for t = start..n-1."""
    n = len(y)
    return np.column_stack([y[start - j : n - j] for j in range(1, lags + 1)]) if lags else np.zeros((n - start, 0))


def fit_table(y: np.ndarray, x: np.ndarray, se_type: str = "hac", maxlags: int | None = None, correction: bool = True) -> dict:
    beta, u, inv = ols(y, x)
    v = covariance(x, u, inv, se_type, maxlags, correction)
    se = np.sqrt(np.diag(v))
    tss = ((y - y.mean()) ** 2).sum()
    return {"params": beta, "bse": se, "tvalues": beta / se, "rsquared": 1 - (u @ u) / tss if tss > 0 else math.nan, "resid": u, "cov": v}
