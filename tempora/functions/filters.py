"""Trend-cycle filters, seasonal decomposition, spectra and long memory of one series."""

from __future__ import annotations

import math

import numpy as np

from .linear import ols
from .optim import golden


def _hp_trend(y: np.ndarray, lamb: float) -> np.ndarray:
    """(I + lamb K'K) trend = y, by a banded LDL' factorisation."""
    n = len(y)
    if n < 3:
        return y.copy()
    d0, d1, d2 = np.ones(n), np.zeros(n), np.zeros(n)
    for i in range(n - 2):
        d0[i : i + 3] += lamb * np.array([1.0, 4.0, 1.0])
        d1[i : i + 2] += lamb * np.array([-2.0, -2.0])
        d2[i] += lamb
    diag, l1, l2, z = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        diag[i] = d0[i] - (l1[i - 1] ** 2 * diag[i - 1] if i > 0 else 0) - (l2[i - 2] ** 2 * diag[i - 2] if i > 1 else 0)
        if i < n - 1:
            l1[i] = (d1[i] - (l1[i - 1] * l2[i - 1] * diag[i - 1] if i > 0 else 0)) / diag[i]
        if i < n - 2:
            l2[i] = d2[i] / diag[i]
        z[i] = y[i] - (l1[i - 1] * z[i - 1] if i > 0 else 0) - (l2[i - 2] * z[i - 2] if i > 1 else 0)
    x = z / diag
    for i in range(n - 2, -1, -1):
        x[i] -= l1[i] * x[i + 1] + (l2[i] * x[i + 2] if i < n - 2 else 0)
    return x


def hp_filter(y: np.ndarray, lamb: float = 1600.0, one_sided: bool = False) -> dict:
    if one_sided:
        trend = np.array([_hp_trend(y[: t + 1], lamb)[-1] for t in range(len(y))])
    else:
        trend = _hp_trend(y, lamb)
    return {"trend": trend, "cycle": y - trend}


def cf_filter(y: np.ndarray, low: float = 6.0, high: float = 32.0, drift: bool = True) -> dict:
    n = len(y)
    x = y - np.arange(n) * (y[-1] - y[0]) / (n - 1) if drift else y.copy()
    a, b = 2 * math.pi / high, 2 * math.pi / low
    j = np.arange(1, n)
    w = np.concatenate([[(b - a) / math.pi], (np.sin(b * j) - np.sin(a * j)) / (math.pi * j)])
    cycle = np.zeros(n)
    for t in range(n):
        after, before = n - 1 - t, t
        total = w[0] * x[t] + w[1:after] @ x[t + 1 : n - 1] + w[1:before] @ x[1:t][::-1]
        total += (-0.5 * w[0] - w[1:after].sum()) * x[-1] + (-0.5 * w[0] - w[1:before].sum()) * x[0]
        cycle[t] = total
    return {"cycle": cycle, "trend": y - cycle}


def hamilton_filter(y: np.ndarray, h: int = 8, p: int = 4) -> dict:
    n, lost = len(y), h + p - 1
    x = np.column_stack([np.ones(n - lost)] + [y[p - 1 - j : n - h - j] for j in range(p)])
    beta, u, _ = ols(y[lost:], x)
    return {"beta": beta, "cycle": u, "trend": y[lost:] - u, "first_index": lost}


def _loess_point(x: np.ndarray, y: np.ndarray, at: float, q: int, degree: int, left: int, right: int, weights: np.ndarray | None) -> float | None:
    """LOESS value at a point from y[left..right] (positions x = 1..n)."""
    n = len(y)
    reach = max(at - x[left], x[right] - at)
    if q > n:
        reach += (q - n) // 2
    r = np.abs(x[left : right + 1] - at)
    w = np.where(r <= 0.999 * reach, np.where(r > 0.001 * reach, (1 - (r / reach) ** 3) ** 3, 1.0), 0.0) if reach > 0 else np.ones(len(r))
    if weights is not None:
        w = w * weights[left : right + 1]
    total = w.sum()
    if total <= 0:
        return None
    w = w / total
    if reach > 0 and degree > 0:
        mean = (w * x[left : right + 1]).sum()
        b = at - mean
        c = (w * (x[left : right + 1] - mean) ** 2).sum()
        if math.sqrt(c) > 0.001 * (n - 1.0):
            w = w * (b / c * (x[left : right + 1] - mean) + 1.0)
    return float((w * y[left : right + 1]).sum())


def _loess(y: np.ndarray, q: int, degree: int, weights: np.ndarray | None = None, jump: int = 1) -> np.ndarray:
    n = len(y)
    x = np.arange(1, n + 1, dtype=float)
    if n < 2:
        return y.copy()
    out = np.full(n, np.nan)
    jump = max(1, min(jump, n - 1))
    half = (q + 1) // 2
    for i in range(0, n, jump):
        if q >= n:
            left, right = 0, n - 1
        else:
            left = min(max(i + 1 - half, 0), n - q)
            right = left + q - 1
        v = _loess_point(x, y, x[i], q, degree, left, right, weights)
        out[i] = y[i] if v is None else v
    if jump > 1:
        if np.isnan(out[-1]):
            left = max(0, n - q)
            v = _loess_point(x, y, x[-1], q, degree, left, n - 1, weights)
            out[-1] = y[-1] if v is None else v
        known = np.flatnonzero(~np.isnan(out))
        out = np.interp(np.arange(n), known, out[known])
    return out


def _moving(x: np.ndarray, k: int) -> np.ndarray:
    c = np.cumsum(np.insert(x, 0, 0.0))
    return (c[k:] - c[:-k]) / k


def stl(y: np.ndarray, period: int, seasonal: int = 7, trend: int | None = None, low_pass: int | None = None, seasonal_deg: int = 1, trend_deg: int = 1, low_pass_deg: int = 1, robust: bool = False, seasonal_jump: int = 1, trend_jump: int = 1, low_pass_jump: int = 1, inner_iter: int | None = None, outer_iter: int | None = None) -> dict:
    n = len(y)
    if n < 2 * period:
        raise ValueError("the series must have two whole periods")
    if trend is None:
        trend = math.ceil(1.5 * period / (1 - 1.5 / seasonal))
        trend += trend % 2 == 0
    if low_pass is None:
        low_pass = period + 1
        low_pass += low_pass % 2 == 0
    inner = inner_iter if inner_iter is not None else (2 if robust else 5)
    outer = outer_iter if outer_iter is not None else (15 if robust else 0)
    t, s, rw = np.zeros(n), np.zeros(n), None
    for k in range(outer + 1):
        for _ in range(inner):
            d = y - t
            c = np.zeros(n + 2 * period)
            for j in range(period):
                sub = d[j::period]
                own = None if rw is None else rw[j::period]
                fit = _loess(sub, seasonal, seasonal_deg, own, seasonal_jump)
                m = len(sub)
                x = np.arange(1, m + 1, dtype=float)
                q = min(seasonal, m)
                first = _loess_point(x, sub, 0.0, seasonal, seasonal_deg, 0, q - 1, own)
                last = _loess_point(x, sub, m + 1.0, seasonal, seasonal_deg, m - q, m - 1, own)
                c[j::period][: m + 2] = np.concatenate([[fit[0] if first is None else first], fit, [fit[-1] if last is None else last]])
            low = _loess(_moving(_moving(_moving(c, period), period), 3), low_pass, low_pass_deg, None, low_pass_jump)
            s = c[period : period + n] - low
            t = _loess(y - s, trend, trend_deg, rw, trend_jump)
        if k < outer:
            r = np.abs(y - s - t)
            h = 6 * np.median(r)
            rw = np.where(r <= 0.001 * h, 1.0, np.where(r <= 0.999 * h, (1 - (r / h) ** 2) ** 2, 0.0)) if h > 0 else np.ones(n)
    return {"seasonal": s, "trend": t, "resid": y - s - t, "weights": np.ones(n) if rw is None else rw, "period": period}


def seasonal_strength(y: np.ndarray, period: int) -> dict:
    d = stl(y, period)
    strength = lambda part: max(0.0, 1 - d["resid"].var(ddof=1) / max((part + d["resid"]).var(ddof=1), 1e-300))
    return {"seasonal_strength": strength(d["seasonal"]), "trend_strength": strength(d["trend"]), "period": period}


def _window(name: str, n: int) -> np.ndarray:
    k = 2 * np.pi * np.arange(n) / n
    if name == "boxcar":
        return np.ones(n)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(k)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(k)
    raise ValueError(f"window {name!r}: boxcar, hann or hamming")


def _segments(x: np.ndarray, nperseg: int, noverlap: int | None, window: str, detrend: str) -> tuple[np.ndarray, np.ndarray]:
    nperseg = min(nperseg, len(x))
    step = nperseg - (nperseg // 2 if noverlap is None else noverlap)
    seg = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::step]
    if detrend == "constant":
        seg = seg - seg.mean(axis=1, keepdims=True)
    w = _window(window, nperseg)
    return np.fft.rfft(seg * w, axis=1), w


def _doubling(n: int, bins: int) -> np.ndarray:
    f = np.full(bins, 2.0)
    f[0] = 1
    if n % 2 == 0:
        f[-1] = 1
    return f


def welch(x: np.ndarray, nperseg: int = 256, fs: float = 1.0, noverlap: int | None = None, window: str = "hann", detrend: str = "none") -> dict:
    f, w = _segments(x, nperseg, noverlap, window, detrend)
    n = len(w)
    psd = (np.abs(f) ** 2).mean(axis=0) * _doubling(n, f.shape[1]) / (fs * (w**2).sum())
    return {"freqs": np.fft.rfftfreq(n, 1 / fs), "psd": psd}


def periodogram(x: np.ndarray, fs: float = 1.0, window: str = "boxcar", detrend: str = "none") -> dict:
    return welch(x, len(x), fs, 0, window, detrend)


def coherence(x: np.ndarray, y: np.ndarray, nperseg: int = 256, fs: float = 1.0, noverlap: int | None = None, window: str = "hann", detrend: str = "none") -> dict:
    f, w = _segments(x, nperseg, noverlap, window, detrend)
    g, _ = _segments(y, nperseg, noverlap, window, detrend)
    cross = (np.conj(f) * g).mean(axis=0)
    return {"freqs": np.fft.rfftfreq(len(w), 1 / fs), "coherence": np.abs(cross) ** 2 / ((np.abs(f) ** 2).mean(axis=0) * (np.abs(g) ** 2).mean(axis=0))}


def long_memory_d(x: np.ndarray, m: int | None = None, method: str = "gph") -> dict:
    n = len(x)
    m = int(math.sqrt(n)) if m is None else m
    lam = 2 * math.pi * np.arange(1, m + 1) / n
    spec = np.abs(np.fft.fft(x - x.mean())[1 : m + 1]) ** 2 / (2 * math.pi * n)
    if method == "gph":
        r = -2 * np.log(2 * np.sin(lam / 2))
        design = np.column_stack([np.ones(m), r])
        b, u, inv = ols(np.log(spec), design)
        sxx = ((r - r.mean()) ** 2).sum()
        return {"d": b[1], "se": math.sqrt(math.pi**2 / 6 / sxx), "se_asymptotic": math.pi / math.sqrt(24 * m), "se_regression": math.sqrt(inv[1, 1] * (u @ u) / (m - 2)), "m": m}
    f = lambda d: math.log((lam ** (2 * d) * spec).mean()) - 2 * d * np.log(lam).mean()
    grid = np.linspace(-0.99, 1.5, 60)
    i = int(np.argmin([f(g) for g in grid]))
    d = golden(f, grid[max(i - 1, 0)], grid[min(i + 1, 59)])
    return {"d": d, "se": 1 / (2 * math.sqrt(m)), "se_asymptotic": 1 / (2 * math.sqrt(m)), "se_regression": None, "m": m}
