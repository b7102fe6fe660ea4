"""Diagnostics, unit-root tests and preprocessing advisors of one series."""

from __future__ import annotations

import math

import numpy as np

from . import special as S
from . import tables as T
from .linear import autocov, llf, lrv, ols, rss
from .optim import golden


def _crit(values) -> dict:
    return {"crit_1": values[0], "crit_5": values[1], "crit_10": values[2]}


def pacf(y: np.ndarray, nlags: int = 20, method: str = "yw") -> dict:
    n = len(y)
    if not 1 <= nlags < n / 2:
        raise ValueError("nlags must be at least 1 and less than half of the length")
    if method == "yw":
        r = autocov(y - y.mean(), nlags)
        return {"pacf": np.concatenate([[1.0], levinson(r, nlags)[1]])}
    if method != "ols":
        raise ValueError("method is yw or ols")
    out = [1.0]
    for k in range(1, nlags + 1):
        x = np.column_stack([np.ones(n - k)] + [y[k - j : n - j] for j in range(1, k + 1)])
        out.append(ols(y[k:], x)[0][-1])
    return {"pacf": out}


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(AR coefficients, partial autocorrelations, innovation variance)."""
    phi, sigma, partial = np.zeros(0), r[0], []
    for k in range(1, order + 1):
        a = (r[k] - phi @ r[k - 1 : 0 : -1][: k - 1]) / sigma if k > 1 else r[1] / sigma
        phi = np.append(phi - a * phi[::-1], a)
        sigma *= 1 - a * a
        partial.append(a)
    return phi, np.array(partial), sigma


def arch_lm(y: np.ndarray, nlags: int = 4) -> dict:
    q, n = nlags, len(y)
    if n < 2 * q + 2:
        raise ValueError("the series is too short for that many lags")
    e = y**2
    x = np.column_stack([np.ones(n - q)] + [e[q - j : n - j] for j in range(1, q + 1)])
    _, u, _ = ols(e[q:], x)
    r2 = 1 - u @ u / ((e[q:] - e[q:].mean()) ** 2).sum()
    stat = (n - q) * r2
    return {"statistic": stat, "p_value": S.chi2_sf(stat, q), "df": q, "nobs": n - q}


def _trend(regression: str, n: int) -> np.ndarray:
    t = np.arange(1, n + 1, dtype=float)
    return {"n": np.zeros((n, 0)), "c": np.ones((n, 1)), "ct": np.column_stack([np.ones(n), t]), "ctt": np.column_stack([np.ones(n), t, t**2])}[regression]


def adf_fit(y: np.ndarray, regression: str, autolag: str | None, maxlag: int | None) -> tuple[float, int, int]:
    """(t statistic of the level, lags, rows)."""
    n = len(y)
    trend = {"n": 0, "c": 1, "ct": 2}[regression]
    if maxlag is None:
        maxlag = int(min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - trend - 1))
    if maxlag < 0 or n - 1 - maxlag <= trend + 1 + maxlag:
        raise ValueError("the series is too short for these lags")
    dy = np.diff(y)

    def design(lag: int, first_lag: int, level_first: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = len(dy) - first_lag
        body = [y[first_lag:-1]] + [dy[first_lag - j : len(dy) - j] for j in range(1, lag + 1)]
        det = _trend(regression, rows)
        body = np.column_stack(body)
        return dy[first_lag:], np.hstack([body, det] if level_first else [det, body])

    lag = maxlag
    if autolag is not None:
        target, full = design(maxlag, maxlag, False)
        base = trend + 1
        rows = len(target)
        if autolag in ("aic", "bic"):
            best = None
            for k in range(maxlag + 1):
                m = base + k
                ic = -2 * llf(rss(target, full[:, :m]), rows) + m * (2 if autolag == "aic" else math.log(rows))
                if best is None or ic < best[0]:
                    best = (ic, k)
            lag = best[1]
        else:
            lag = 0
            for k in range(maxlag, 0, -1):
                b, u, inv = ols(target, full[:, : base + k])
                t = b[-1] / math.sqrt(inv[-1, -1] * (u @ u) / (rows - base - k))
                if abs(t) >= 1.6448536269514722:
                    lag = k
                    break
    target, x = design(lag, lag, True)
    b, u, inv = ols(target, x)
    return b[0] / math.sqrt(inv[0, 0] * (u @ u) / (len(target) - x.shape[1])), lag, len(target)


def adf(y: np.ndarray, regression: str = "c", autolag: str | None = "aic", maxlag: int | None = None) -> dict:
    if np.ptp(y) == 0:
        raise ValueError("the series is constant")
    stat, lag, rows = adf_fit(y, regression, autolag, maxlag)
    return {"statistic": stat, "p_value": T.surface_p(stat, T.MACKINNON[regression]), "used_lag": lag, "nobs": rows, **_crit(T.surface_crit(T.MACKINNON[regression], rows))}


def kpss(y: np.ndarray, regression: str = "c", nlags: int | str | None = None) -> dict:
    n = len(y)
    x = _trend(regression, n)
    u = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    if nlags is None or nlags == "auto":
        cov = int(n ** (2 / 9))
        s0, s1 = u @ u / n, 0.0
        for i in range(1, cov + 1):
            dot = u[i:] @ u[: n - i] / (n / 2)
            s0 += dot
            s1 += i * dot
        lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    elif nlags == "legacy":
        lags = min(math.ceil(12 * (n / 100) ** 0.25), n - 1)
    else:
        lags = int(nlags)
    stat = (np.cumsum(u) ** 2).sum() / n**2 / lrv(u, "bartlett", lags)
    return {"statistic": stat, "p_value": float(np.interp(stat, T.KPSS[regression], T.KPSS_P)), "lags": lags}


def check_stationarity(y: np.ndarray, alpha: float = 0.05) -> dict:
    a, k = adf(y), kpss(y)
    reject, against = a["p_value"] < alpha, k["p_value"] < alpha
    quadrant = {(True, False): "Stationary", (False, True): "UnitRoot", (True, True): "Conflict", (False, False): "Inconclusive"}[reject, against]
    advice = {"Stationary": "Proceed", "UnitRoot": "Difference", "Conflict": "Detrend", "Inconclusive": "Difference"}[quadrant]
    return {"quadrant": quadrant, "recommendation": advice, "adf_statistic": a["statistic"], "adf_p_value": a["p_value"], "kpss_statistic": k["statistic"], "kpss_p_value": k["p_value"], "alpha": alpha}


def phillips_perron(y: np.ndarray, regression: str = "c", test_type: str = "tau", lags: int | None = None) -> dict:
    n = len(y) - 1
    lags = math.ceil(12 * (n / 100) ** 0.25) if lags is None else lags
    x = np.hstack([y[:-1, None], _trend(regression, n)])
    b, u, inv = ols(y[1:], x)
    k = x.shape[1]
    s2 = u @ u / (n - k)
    g0 = u @ u / n
    lam2 = lrv(u, "bartlett", lags)
    sigma = math.sqrt(s2 * inv[0, 0])
    z_alpha = n * (b[0] - 1) - 0.5 * (n**2 * sigma**2 / s2) * (lam2 - g0)
    z_tau = math.sqrt(g0 / lam2) * (b[0] - 1) / sigma - 0.5 * (lam2 - g0) / math.sqrt(lam2) * n * sigma / math.sqrt(s2)
    stat = z_tau if test_type == "tau" else z_alpha
    if test_type == "tau":
        p, crit = T.surface_p(z_tau, T.MACKINNON[regression]), T.surface_crit(T.MACKINNON[regression], n)
    else:
        p, crit = T.z_p(z_alpha, regression), T.surface_crit(T.ADF_Z[regression], n)
    return {"stat": stat, "ztau": z_tau, "zalpha": z_alpha, "pvalue": p, "lags": lags, "nobs": n, **_crit(crit)}


def _gls_detrend(y: np.ndarray, regression: str) -> np.ndarray:
    n, c = len(y), {"c": -7.0, "ct": -13.5}[regression]
    z, a = _trend(regression, n), 1 + c / n
    qz, qy = z.copy(), y.copy()
    qz[1:] -= a * z[:-1]
    qy[1:] -= a * y[:-1]
    return y - z @ np.linalg.lstsq(qz, qy, rcond=None)[0]


def _no_trend_fit(z: np.ndarray, lag: int, first: int) -> tuple[float, float, int, int]:
    """(t of the level, residual sum, rows, regressors) of the augmented regression without deterministics."""
    dz = np.diff(z)
    x = np.column_stack([z[first:-1]] + [dz[first - j : len(dz) - j] for j in range(1, lag + 1)])
    b, u, inv = ols(dz[first:], x)
    return b[0] / math.sqrt(inv[0, 0] * (u @ u) / (len(u) - x.shape[1])), float(u @ u), len(u), x.shape[1]


def dfgls(y: np.ndarray, regression: str = "c", lags: int | None = None, max_lags: int | None = None, method: str = "aic") -> dict:
    n = len(y)
    z = _gls_detrend(y, regression)
    if lags is None:
        top = int(math.ceil(12 * (n / 100) ** 0.25)) if max_lags is None else max_lags
        top = min(top, n // 2 - {"c": 1, "ct": 2}[regression] - 1)
        d = _trend(regression, n)
        detrended = y - d @ np.linalg.lstsq(d, y, rcond=None)[0]
        if method == "t-stat":
            lags = 0
            for k in range(top, 0, -1):
                dz = np.diff(detrended)
                x = np.column_stack([detrended[top:-1]] + [dz[top - j : len(dz) - j] for j in range(1, k + 1)])
                b, u, inv = ols(dz[top:], x)
                if abs(b[-1] / math.sqrt(inv[-1, -1] * (u @ u) / (len(u) - x.shape[1]))) >= 1.6448536269514722:
                    lags = k
                    break
        else:
            scores = []
            for k in range(top + 1):
                _, ssr, rows, m = _no_trend_fit(detrended, k, top)
                scores.append(rows * (math.log(2 * math.pi) + math.log(ssr / rows) + 1) + m * (2 if method == "aic" else math.log(rows)))
            lags = int(np.argmin(scores))
    stat, _, rows, _ = _no_trend_fit(z, lags, lags)
    return {"statistic": stat, "p_value": T.surface_p(stat, T.DFGLS[regression]), "used_lag": lags, "nobs": rows, **_crit(T.surface_crit(T.DFGLS[regression], rows)), "trend": regression}


def phillips_ouliaris(y: np.ndarray, x: np.ndarray, trend: str = "c", test_type: str = "Zt", bandwidth: float | None = None) -> dict:
    n = len(y)
    x = x.reshape(n, -1)
    z = np.hstack([x, _trend(trend, n)])
    u = y - z @ np.linalg.lstsq(z, y, rcond=None)[0]
    rho = u[1:] @ u[:-1] / (u[:-1] @ u[:-1])
    k = u[1:] - rho * u[:-1]
    m = len(k)
    lags = math.floor(4 * (m / 100) ** (2 / 9)) if bandwidth is None else bandwidth
    s2, full = k @ k / m, lrv(k, "bartlett", lags)
    one = (full - s2) / 2
    z_a = m * (rho - 1) - one / (u[:-1] @ u[:-1] / m**2)
    z_t = (rho - 1 - one * m / (u[:-1] @ u[:-1])) / math.sqrt(full / (u[:-1] @ u[:-1]))
    v = x.shape[1] + 1
    stat = z_t if test_type == "Zt" else z_a
    return {"stat": stat, "pvalue": T.coint_p(z_t, trend, v) if test_type == "Zt" else None, "lags": lags, "nobs": n, "n_vars": v, **_crit(T.coint_crit(v, n, trend) if test_type == "Zt" else [math.nan] * 3)}


def zivot_andrews(y: np.ndarray, regression: str = "c", trim: float = 0.15, max_lags: int | None = None, autolag: str | None = "aic", lags: int | None = None) -> dict:
    """The least t statistic over break dates; the lags are chosen once, without a break (by rule, truncated, where neither they nor a criterion are given)."""
    n = len(y)
    if not 0 <= trim <= 1 / 3:
        raise ValueError("trim must be from 0 to 1/3")
    if lags is None:
        lags = adf_fit(y, "ct", autolag, max_lags)[1] if autolag is not None else int(12 * (n / 100) ** 0.25) if max_lags is None else max_lags
    if lags + 1 > int(n * trim):
        raise ValueError("too many lags: the first break dates leave no row before them")
    dy = np.diff(y)
    rows = np.arange(lags, len(dy))
    body = np.column_stack([np.ones(len(rows)), rows + 1.0, y[rows]] + [dy[rows - j] for j in range(1, lags + 1)])
    best = (math.inf, -1)
    edge = int(n * trim)
    for b in range(edge + 1, n - edge + 1):
        after = (rows + 2 > b).astype(float)
        # Without a shift of the level, the change of slope starts one row earlier.
        extra = {"c": [after], "t": [np.maximum(rows + 3.0 - b, 0)], "ct": [after, after * (rows + 3 - b)]}[regression]
        x = np.column_stack([body, *extra])
        try:
            coef, u, inv = ols(dy[rows], x)
        except ValueError:
            continue
        t = coef[2] / math.sqrt(inv[2, 2] * (u @ u) / (len(u) - x.shape[1]))
        if t < best[0]:
            best = (t, b)
    crit = [float(np.interp(q, T.ZA_PERCENT, T.ZA[regression])) for q in (1, 5, 10)]
    return {"stat": best[0], "pvalue": T.za_p(best[0], regression), "break_index": best[1] - 1, "lags": lags, "nobs": n, "trim": trim, "regression": regression, **_crit(crit)}


def ndiffs(y: np.ndarray, test: str = "kpss", alpha: float = 0.05, max_d: int = 2) -> dict:
    d, steps, stop = 0, [], "MaxD"
    while True:
        if np.ptp(y) == 0:
            stop = "Constant"
            break
        if test == "kpss":
            r = kpss(y)
            more = r["p_value"] < alpha
        else:
            r = adf(y) if test == "adf" else phillips_perron(y)
            r = {"statistic": r.get("statistic", r.get("stat")), "p_value": r.get("p_value", r.get("pvalue")), "lags": r.get("used_lag", r.get("lags"))}
            more = r["p_value"] > alpha
        steps.append({"d": d, "statistic": r["statistic"], "p_value": r["p_value"], "needs_differencing": more})
        if not more:
            stop = "Stationary"
            break
        if d == max_d:
            break
        y, d = np.diff(y), d + 1
    return {"d": d, "n": len(y), "test": test, "alpha": alpha, "max_d": max_d, "stop": stop, "steps": steps}


def nsdiffs(y: np.ndarray, period: int, alpha: float = 0.05, max_d: int = 1) -> dict:
    from .filters import seasonal_strength

    d, steps, stop = 0, [], "MaxD"
    while True:
        if np.ptp(y) == 0:
            stop = "Constant"
            break
        if len(y) < 2 * period:
            stop = "TooShort"
            break
        s = seasonal_strength(y, period)
        more = s["seasonal_strength"] >= 0.64
        steps.append({"d": d, **s, "needs_differencing": more})
        if not more:
            stop = "WeakSeasonality"
            break
        if d == max_d:
            break
        y, d = y[period:] - y[:-period], d + 1
    return {"d": d, "n": len(y), "period": period, "threshold": 0.64, "alpha": alpha, "max_d": max_d, "stop": stop, "steps": steps}


def box_cox_llf(y: np.ndarray, lam: float) -> float:
    logs = np.log(y)
    z = logs if abs(lam) < 1e-12 else np.expm1(lam * logs) / lam
    return (lam - 1) * logs.sum() - len(y) / 2 * math.log(z.var())


def guerrero_cv(y: np.ndarray, lam: float, period: int) -> float:
    k = len(y) // period
    b = y[len(y) - k * period :].reshape(k, period)
    r = b.std(axis=1, ddof=1) / b.mean(axis=1) ** (1 - lam)
    return float(r.std(ddof=1) / r.mean())


def box_cox_lambda(y: np.ndarray, method: str = "mle", bounds: tuple = (-2.0, 2.0), period: int | None = None) -> dict:
    if (y <= 0).any():
        raise ValueError("the transform needs positive values")
    low, high = bounds
    if method == "guerrero" and period is None:
        raise ValueError("guerrero needs a period")
    f = (lambda v: -box_cox_llf(y, v)) if method == "mle" else (lambda v: guerrero_cv(y, v, period))
    grid = np.linspace(low, high, 41)
    i = int(np.argmin([f(v) for v in grid]))
    lam = golden(f, grid[max(0, i - 1)], grid[min(40, i + 1)])
    out = {"lambda": lam, "objective": -f(lam) if method == "mle" else f(lam), "method": method, "lower": low, "upper": high, "at_bound": min(lam - low, high - lam) < 1e-6, "n": len(y), "period": period}
    if method == "mle":
        top = box_cox_llf(y, lam)
        out |= {"loglik_0": box_cox_llf(y, 0.0), "loglik_1": box_cox_llf(y, 1.0), "lr_0": 2 * (top - box_cox_llf(y, 0.0)), "lr_1": 2 * (top - box_cox_llf(y, 1.0))}
    return out
