"""State-space, ARIMA, regime-switching and score-driven models of one series."""

from __future__ import annotations

import math

import numpy as np

from . import special as S
from .optim import hessian, minimise, nelder_mead


def local_level_smooth(y: np.ndarray, sigma2_eps: float, sigma2_eta: float) -> dict:
    """Exact-diffuse filter and fixed-interval smoother; NaN is missing."""
    n = len(y)
    a, p, diffuse = 0.0, 0.0, True
    filt, fvar, loglik, skipped = np.zeros(n), np.zeros(n), 0.0, 0
    for t in range(n):
        if t and not diffuse:
            p += sigma2_eta
        if np.isnan(y[t]):
            skipped += diffuse
            filt[t], fvar[t] = a, np.inf if diffuse else p
            continue
        if diffuse:
            a, p, diffuse = y[t], sigma2_eps, False
            skipped += 1
            loglik -= 0.5 * math.log(2 * math.pi)
        else:
            f, v = p + sigma2_eps, y[t] - a
            loglik -= 0.5 * (math.log(2 * math.pi * f) + v * v / f)
            a, p = a + p / f * v, p - p * p / f
        filt[t], fvar[t] = a, p
    s, sv = filt.copy(), fvar.copy()
    for t in range(n - 2, -1, -1):
        if np.isinf(fvar[t]):
            s[t], sv[t] = s[t + 1], sv[t + 1] + sigma2_eta
            continue
        c = fvar[t] / (fvar[t] + sigma2_eta)
        s[t] = filt[t] + c * (s[t + 1] - filt[t])
        sv[t] = fvar[t] + c * c * (sv[t + 1] - fvar[t] - sigma2_eta)
    return {"loglik": loglik, "d_diffuse": skipped, "filtered_state": filt, "filtered_state_var": fvar, "smoothed_state": s, "smoothed_state_var": sv}


def arma_filter(y: np.ndarray, phi: np.ndarray, theta: np.ndarray):
    """(innovations, their variances in units of sigma2, last state and its variance) of a stationary ARMA, NaN is missing."""
    r = max(len(phi), len(theta) + 1)
    t = np.zeros((r, r))
    t[: len(phi), 0] = phi
    t[:-1, 1:] += np.eye(r - 1)
    rv = np.zeros(r)
    rv[0] = 1
    rv[1 : len(theta) + 1] = theta
    q = np.outer(rv, rv)
    p = np.linalg.solve(np.eye(r * r) - np.kron(t, t), q.ravel()).reshape(r, r)
    a = np.zeros(r)
    v, f = np.full(len(y), np.nan), np.full(len(y), np.nan)
    steady = False
    for k in range(len(y)):
        f[k] = p[0, 0]
        if np.isnan(y[k]):
            a, p = t @ a, t @ p @ t.T + q
            steady = False
            continue
        v[k] = y[k] - a[0]
        gain = t @ p[:, 0] / f[k]
        a = t @ a + gain * v[k]
        if not steady:
            new = t @ p @ t.T + q - np.outer(gain, gain) * f[k]
            steady = bool(np.abs(new - p).max() < 1e-14)
            p = new
    return v, f, a, p, t, q


def ar_loglik(y: np.ndarray, coeffs, sigma2: float, intercept: float = 0.0) -> dict:
    phi = np.atleast_1d(np.asarray(coeffs, float))
    mu = intercept / (1 - phi.sum())
    v, f, *_ = arma_filter(y - mu, phi, np.zeros(0))
    ok = ~np.isnan(v)
    return {"loglik": float(-0.5 * (np.log(2 * math.pi * sigma2 * f[ok]) + v[ok] ** 2 / (sigma2 * f[ok])).sum())}


def _stable(u: np.ndarray) -> np.ndarray:
    """Unconstrained numbers to coefficients of a stationary recursion (partial autocorrelations through u / sqrt(1 + u^2))."""
    out = np.zeros(0)
    for r in u / np.sqrt(1 + u**2):
        out = np.append(out - r * out[::-1], r)
    return out


def _seasonal_poly(a: np.ndarray, big: np.ndarray, s: int, sign: float) -> np.ndarray:
    x, z = np.concatenate([[1.0], sign * a]), np.zeros(len(big) * s + 1)
    z[0] = 1
    z[s::s] = sign * big
    return sign * np.convolve(x, z)[1:]


def arima_fit(y: np.ndarray, p: int = 1, d: int = 0, q: int = 0, seasonal: tuple | None = None, constant: bool = True, forecast_steps: int = 0, conf_alpha: float | None = None) -> dict:
    bp, bd, bq, s = seasonal or (0, 0, 0, 1)
    levels, w = [y], y
    for _ in range(bd):
        w = w[s:] - w[:-s]
        levels.append(w)
    for _ in range(d):
        w = np.diff(w)
        levels.append(w)
    n = len(w)
    scale = w.std() or 1.0
    z = w / scale

    def unpack(u):
        i = int(constant)
        mu = u[0] if constant else 0.0
        parts = np.split(u[i:], np.cumsum([p, q, bp])[:3])
        return mu, _stable(parts[0]), -_stable(-parts[1]), _stable(parts[2]), -_stable(-parts[3])

    def concentrated(mu, ar, ma, sar, sma):
        phi, theta = _seasonal_poly(ar, sar, s, -1.0), _seasonal_poly(ma, sma, s, 1.0)
        v, f, a, pv, t, qq = arma_filter(z - mu, phi, theta)
        s2 = float((v**2 / f).mean())
        return 0.5 * n * (math.log(2 * math.pi * s2) + 1) + 0.5 * np.log(f).sum(), s2, (v, f, a, pv, t, qq)

    def objective(u):
        try:
            return concentrated(*unpack(u))[0]
        except (np.linalg.LinAlgError, ValueError):
            return 1e10

    start = np.concatenate([[z.mean()] * constant, np.full(p, 0.1), np.full(q, 0.1), np.full(bp, 0.1), np.full(bq, 0.1)])
    u, nll, ok = minimise(objective, start) if len(start) else (start, objective(start), True)
    mu, ar, ma, sar, sma = unpack(u)
    _, s2, (v, f, a, pv, t, qq) = concentrated(mu, ar, ma, sar, sma)
    loglik = -nll - n * math.log(scale)
    k = len(start) + 1
    level = (1 - ar.sum()) * (1 - sar.sum())  # the constant is the intercept: the mean times this
    params = np.concatenate([[mu * level * scale] * constant, ar, ma, sar, sma, [s2 * scale**2]])
    names = ["const"] * constant + [f"ar{i + 1}" for i in range(p)] + [f"ma{i + 1}" for i in range(q)] + [f"sar{i + 1}" for i in range(bp)] + [f"sma{i + 1}" for i in range(bq)] + ["sigma2"]

    def natural(theta):
        i = int(constant)
        parts = np.split(theta[i:-1], np.cumsum([p, q, bp])[:3])
        phi, th = _seasonal_poly(parts[0], parts[2], s, -1.0), _seasonal_poly(parts[1], parts[3], s, 1.0)
        try:
            vv, ff, *_ = arma_filter(z - (theta[0] / (1 - phi.sum()) if constant else 0.0), phi, th)
        except np.linalg.LinAlgError:
            return 1e10
        return 0.5 * (np.log(2 * math.pi * theta[-1] * np.abs(ff)) + vv**2 / (theta[-1] * ff)).sum()

    unit = np.concatenate([[mu * level] * constant, ar, ma, sar, sma, [s2]])
    units = np.concatenate([[scale] * constant, np.ones(p + q + bp + bq), [scale**2]])
    try:
        cov = np.linalg.inv(hessian(natural, unit)) * np.outer(units, units)
        cov_ok = bool((np.diag(cov) > 0).all())
    except np.linalg.LinAlgError:
        cov, cov_ok = np.full((k, k), np.nan), False
    out = {
        "params": params, "param_names": names, "loglik": loglik, "aic": -2 * loglik + 2 * k, "bic": -2 * loglik + math.log(n) * k,
        "bse": np.sqrt(np.abs(np.diag(cov))) if cov_ok else np.full(k, np.nan), "param_cov": cov, "cov_ok": cov_ok, "converged": ok, "residuals": v * scale,
    }
    if forecast_steps:
        h = forecast_steps
        mean, psi, unit_state = np.zeros(h), np.zeros(h), qq[:, 0].copy()
        state = a.copy()
        for j in range(h):
            mean[j] = (state[0] + mu) * scale
            psi[j] = unit_state[0]
            state, unit_state = t @ state, t @ unit_state
        for level in reversed(levels[:-1]):
            lag = 1 if len(levels) - 1 - [x is level for x in levels].index(True) <= d else s
            past = list(level)
            for j in range(h):
                past.append(mean[j] + past[-lag])
            mean = np.array(past[-h:])
            for j in range(lag, h):
                psi[j] += psi[j - lag]
        se = np.sqrt(np.cumsum(psi**2) * s2) * scale
        out |= {"forecast_mean": mean, "forecast_se": se}
        if conf_alpha is not None:
            zc = S.norm_ppf(1 - conf_alpha / 2)
            out |= {"forecast_lower": mean - zc * se, "forecast_upper": mean + zc * se, "conf_alpha": conf_alpha}
    return out


def markov_switching_ar(y: np.ndarray, k_regimes: int = 2, order: int = 1, switching_variance: bool = True, max_iter: int = 500, tol: float = 1e-6) -> dict:
    """EM for means that switch in an autoregression y_t = c_s + sum phi y_{t-j} + e, common phi."""
    n, k = len(y) - order, k_regimes
    target = y[order:]
    lags = np.column_stack([y[order - j : len(y) - j] for j in range(1, order + 1)]) if order else np.zeros((n, 0))
    phi = np.zeros(order)
    c = np.quantile(target, (np.arange(k) + 0.5) / k)
    var = np.full(k, target.var())
    trans = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(trans, 0.9)
    last, done, it = -np.inf, False, 0
    for it in range(1, max_iter + 1):
        e = target[:, None] - lags @ phi[:, None] - c if order else target[:, None] - c
        dens = np.exp(-0.5 * e**2 / var) / np.sqrt(2 * math.pi * var)
        filt, pred, loglik = np.zeros((n, k)), np.zeros((n, k)), 0.0
        state = np.linalg.lstsq(np.vstack([np.eye(k) - trans.T, np.ones(k)]), np.append(np.zeros(k), 1.0), rcond=None)[0]
        for t in range(n):
            pred[t] = state
            joint = state * dens[t]
            total = joint.sum()
            loglik += math.log(max(total, 1e-300))
            filt[t] = joint / total if total > 0 else state
            state = trans.T @ filt[t]
        smooth, pairs = filt.copy(), np.zeros((k, k))
        for t in range(n - 2, -1, -1):
            ratio = smooth[t + 1] / np.maximum(pred[t + 1], 1e-300)
            pairs += filt[t][:, None] * trans * ratio
            smooth[t] = filt[t] * (trans @ ratio)
        if abs(loglik - last) < tol:
            done = True
            break
        last = loglik
        pairs += 1e-10
        trans = pairs / pairs.sum(axis=1, keepdims=True)
        w = smooth / var + 1e-12
        a = np.zeros((k + order, k + order))
        b = np.zeros(k + order)
        a[:k, :k] = np.diag(w.sum(axis=0))
        b[:k] = w.T @ target
        if order:
            a[:k, k:] = w.T @ lags
            a[k:, :k] = a[:k, k:].T
            a[k:, k:] = lags.T @ (lags * w.sum(axis=1)[:, None])
            b[k:] = lags.T @ (target * w.sum(axis=1))
        sol = np.linalg.solve(a, b)
        c, phi = sol[:k], sol[k:]
        e = target[:, None] - (lags @ phi)[:, None] - c
        var = (smooth * e**2).sum(axis=0) / smooth.sum(axis=0) if switching_variance else np.full(k, (smooth * e**2).sum() / n)
        var = np.maximum(var, 1e-6 * target.var())
    order_by = np.argsort(c)
    return {
        "transition": trans[np.ix_(order_by, order_by)], "means": c[order_by], "ar": phi, "variances": var[order_by], "loglik": loglik, "iterations": it, "converged": done,
        "expected_durations": 1 / (1 - np.diag(trans)[order_by]), "smoothed_prob": smooth[:, order_by], "filtered_prob": filt[:, order_by],
    }


def gas_volatility(y: np.ndarray, density: str = "gaussian", horizon: int = 0) -> dict:
    """f_{t+1} = omega + a s_t + b f_t of the variance, with inverse-information scaling."""
    scale = y.std() or 1.0
    z = y / scale

    def run(theta):
        w, a, b = theta[0], theta[1], theta[2]
        nu = theta[3] if density != "gaussian" else np.inf
        f = w / (1 - b)
        path, ll = np.zeros(len(z)), 0.0
        for t, x in enumerate(z):
            path[t] = f
            if not 1e-10 < f < 1e8:
                return None
            if density == "gaussian":
                ll += -0.5 * (math.log(2 * math.pi * f) + x * x / f)
                score = x * x - f
            else:
                ll += math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log((nu - 2) * math.pi * f) - (nu + 1) / 2 * math.log1p(x * x / ((nu - 2) * f))
                score = (1 + 3 / nu) * ((nu + 1) / (nu - 2) * x * x / (1 + x * x / ((nu - 2) * f)) - f)
            f = w + a * score + b * f
        return ll, path, f

    def objective(theta):
        if theta[0] <= 0 or not 0 <= theta[1] < 1 or not 0 <= theta[2] < 0.9999 or (len(theta) > 3 and not 2.05 < theta[3] < 300):
            return 1e10
        got = run(theta)
        return 1e10 if got is None else -got[0]

    start = np.array([0.05, 0.08, 0.9] + ([8.0] if density != "gaussian" else []))
    x, nll, ok = nelder_mead(objective, start, step=0.3)
    ll, path, nxt = run(x)
    n, k = len(y), len(x)
    loglik = ll - n * math.log(scale)
    fc = []
    f = nxt
    for _ in range(horizon):
        fc.append(f * scale**2)
        f = x[0] + x[2] * f
    return {"omega": x[0] * scale**2, "a": x[1], "b": x[2], "nu": x[3] if k > 3 else None, "variance": path * scale**2, "std_resid": z / np.sqrt(path), "loglik": loglik, "aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik, "next_variance": nxt * scale**2, "converged": ok, "forecast": fc}


def dcs_local_level(y: np.ndarray, density: str = "t") -> dict:
    """mu_{t+1} = mu_t + kappa u_t with the score of the density."""
    centre, scale = np.median(y), y.std() or 1.0
    z = (y - centre) / scale
    start_level = float(np.median(z[:10]))

    def run(theta):
        kappa, s = theta[0], theta[1]
        nu = theta[2] if density == "t" else None
        mu, path, ll = start_level, np.zeros(len(z)), 0.0
        for t, x in enumerate(z):
            path[t] = mu
            e = x - mu
            if density == "t":
                r = e * e / (nu * s * s)
                ll += math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s) - (nu + 1) / 2 * math.log1p(r)
                u = e / (1 + r)
            elif density == "laplace":
                ll += -math.log(2 * s) - abs(e) / s
                u = math.copysign(s, e) if e else 0.0
            else:
                ll += -0.5 * math.log(2 * math.pi) - math.log(s) - 0.5 * e * e / (s * s)
                u = e
            mu += kappa * u
        return ll, path, mu

    def objective(theta):
        if not 0 <= theta[0] < 5 or theta[1] <= 1e-6 or (density == "t" and not 1 < theta[2] < 300):
            return 1e10
        return -run(theta)[0]

    x, nll, ok = nelder_mead(objective, np.array([0.3, 0.7] + ([6.0] if density == "t" else [])), step=0.3)
    ll, path, nxt = run(x)
    try:
        se = np.sqrt(np.abs(np.diag(np.linalg.inv(hessian(objective, x)))))
    except np.linalg.LinAlgError:
        se = np.full(len(x), np.nan)
    n, k = len(y), len(x)
    loglik = ll - n * math.log(scale)
    return {"kappa": x[0], "kappa_se": se[0], "scale": x[1] * scale, "scale_se": se[1] * scale, "nu": x[2] if k > 2 else None, "nu_se": se[2] if k > 2 else None, "level": path * scale + centre, "resid": y - (path * scale + centre), "next_level": nxt * scale + centre, "loglik": loglik, "aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik, "converged": ok, "n_obs": n, "density": density}
