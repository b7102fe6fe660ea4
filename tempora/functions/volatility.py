"""GARCH family, correlations, tails and copulas."""

from __future__ import annotations

import math

import numpy as np

from . import special as S
from .optim import bfgs, hessian, minimise, nelder_mead


def _recursion(e: np.ndarray, vol: str, w: float, alpha: np.ndarray, gamma: np.ndarray, beta: np.ndarray, backcast: float) -> np.ndarray:
    n = len(e)
    h = np.zeros(n)
    e2 = e * e
    if vol == "egarch":
        lh = np.zeros(n)
        z = np.zeros(n)
        base = math.log(backcast)
        for t in range(n):
            v = w
            for i, a in enumerate(alpha):
                if t - 1 - i >= 0:
                    v += a * (abs(z[t - 1 - i]) - math.sqrt(2 / math.pi))
            for i, g in enumerate(gamma):
                if t - 1 - i >= 0:
                    v += g * z[t - 1 - i]
            for i, b in enumerate(beta):
                v += b * (lh[t - 1 - i] if t - 1 - i >= 0 else base)
            lh[t] = min(max(v, -50), 50)
            z[t] = e[t] / math.exp(lh[t] / 2)
        return np.exp(lh)
    if len(alpha) == 1 and len(beta) == 1 and len(gamma) <= 1:
        a, b, g = alpha[0], beta[0], gamma[0] if len(gamma) else 0.0
        drive = w + a * e2 + g * e2 * (e < 0)
        v = w + a * backcast + 0.5 * g * backcast + b * backcast
        h[0] = v
        for t in range(1, n):
            v = drive[t - 1] + b * v
            h[t] = v
        return h
    for t in range(n):
        v = w
        for i, a in enumerate(alpha):
            v += a * (e2[t - 1 - i] if t - 1 - i >= 0 else backcast)
        for i, g in enumerate(gamma):
            v += g * (e2[t - 1 - i] * (e[t - 1 - i] < 0) if t - 1 - i >= 0 else 0.5 * backcast)
        for i, b in enumerate(beta):
            v += b * (h[t - 1 - i] if t - 1 - i >= 0 else backcast)
        h[t] = v
    return h


def garch_fit(y: np.ndarray, vol: str = "garch", mean: str = "zero", dist: str = "normal", p: int = 1, o: int = 1, q: int = 1, forecast_horizon: int = 0) -> dict:
    o = 0 if vol == "garch" else o
    scale = y.std() or 1.0
    z = y / scale
    n = len(z)
    has_mean = mean == "constant"

    def parts(theta):
        i = int(has_mean)
        w = theta[i]
        alpha, gamma, beta = theta[i + 1 : i + 1 + p], theta[i + 1 + p : i + 1 + p + o], theta[i + 1 + p + o : i + 1 + p + o + q]
        return (theta[0] if has_mean else 0.0), w, alpha, gamma, beta, (theta[-1] if dist == "t" else None)

    def obs(theta):
        mu, w, alpha, gamma, beta, nu = parts(theta)
        e = z - mu
        m = min(75, n)
        wt = 0.94 ** np.arange(m)
        h = _recursion(e, vol, w, alpha, gamma, beta, float((wt / wt.sum()) @ e[:m] ** 2))
        h = np.maximum(h, 1e-12)
        if nu is None:
            return -0.5 * (np.log(2 * math.pi * h) + e**2 / h), h, e
        c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))
        return c - 0.5 * np.log(h) - (nu + 1) / 2 * np.log1p(e**2 / ((nu - 2) * h)), h, e

    def objective(theta):
        _, w, alpha, gamma, beta, nu = parts(theta)
        if nu is not None and not 2.05 < nu < 500:
            return 1e10
        if vol == "egarch":
            if abs(beta.sum()) >= 0.99999:
                return 1e10
        elif w <= 1e-10 or (alpha < 0).any() or (beta < 0).any() or (o and (alpha[:o] + gamma < 0).any()) or alpha.sum() + 0.5 * gamma.sum() + beta.sum() >= 0.99999:
            return 1e10
        v = -obs(theta)[0].sum()
        return v if np.isfinite(v) else 1e10

    best = None
    for a0, b0 in ((0.05, 0.9), (0.1, 0.8), (0.2, 0.5)):
        w0 = (1 - a0 - b0) if vol != "egarch" else 0.0
        s = np.concatenate([[z.mean()] * has_mean, [w0], np.full(p, a0 / p), np.full(o, 0.02), np.full(q, b0 / max(q, 1)), [8.0] * (dist == "t")])
        v = objective(s)
        if best is None or v < best[0]:
            best = (v, s)
    x, nll, ok = nelder_mead(objective, best[1], step=0.2, restarts=2)
    try:
        x2, nll2, ok2 = bfgs(objective, x)
        if nll2 < nll:
            x, nll, ok = x2, nll2, ok or ok2
    except (FloatingPointError, np.linalg.LinAlgError):
        pass
    ll, h, e = obs(x)
    names = ["mu"] * has_mean + ["omega"] + [f"alpha{i + 1}" for i in range(p)] + [f"gamma{i + 1}" for i in range(o)] + [f"beta{i + 1}" for i in range(q)] + ["nu"] * (dist == "t")
    units = np.ones(len(x))
    if has_mean:
        units[0] = scale
    shift = np.zeros(len(x))
    if vol == "egarch":
        shift[int(has_mean)] = (1 - x[int(has_mean) + 1 + p + o :][:q].sum()) * 2 * math.log(scale)
    else:
        units[int(has_mean)] = scale**2
    hess = hessian(lambda t: -obs(t)[0].sum(), x)
    scores = np.column_stack([(obs(x + d)[0] - obs(x - d)[0]) / (2 * d.max()) for d in np.eye(len(x)) * 1e-5])
    try:
        inv = np.linalg.inv(hess)
        mle, robust = np.sqrt(np.abs(np.diag(inv))), np.sqrt(np.abs(np.diag(inv @ scores.T @ scores @ inv)))
    except np.linalg.LinAlgError:
        mle = robust = np.full(len(x), np.nan)
    loglik, k = float(ll.sum()) - n * math.log(scale), len(x)
    out = {"params": x * units + shift, "param_names": names, "loglik": loglik, "aic": 2 * k - 2 * loglik, "bic": k * math.log(n) - 2 * loglik, "se_mle": mle * units, "se_robust": robust * units, "converged": ok, "conditional_volatility": np.sqrt(h) * scale, "std_residuals": e / np.sqrt(h)}
    if forecast_horizon:
        _, w, alpha, gamma, beta, _ = parts(x)
        steps = 1 if vol == "egarch" else forecast_horizon
        hh, ee = list(h), list(e**2)
        neg = list((e < 0).astype(float))
        fc = []
        if vol == "egarch":
            fc = [_recursion(np.append(e, 0.0), vol, w, alpha, gamma, beta, float((e[:75] ** 2).mean()))[-1] * scale**2]
        else:
            for _ in range(steps):
                v = w + sum(a * ee[-1 - i] for i, a in enumerate(alpha)) + sum(g * ee[-1 - i] * neg[-1 - i] for i, g in enumerate(gamma)) + sum(b * hh[-1 - i] for i, b in enumerate(beta))
                fc.append(v * scale**2)
                hh.append(v)
                ee.append(v)
                neg.append(0.5)
        out["variance_forecast"] = fc
    return out


def _standardised(returns: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    fits = [garch_fit(returns[:, j]) for j in range(returns.shape[1])]
    return np.column_stack([f["std_residuals"] for f in fits]), np.column_stack([f["conditional_volatility"] for f in fits]), sum(f["loglik"] for f in fits)


def _correlation_loglik(z: np.ndarray, r: np.ndarray) -> float:
    sign, logdet = np.linalg.slogdet(r)
    q = np.einsum("ti,ij,tj->t", z, np.linalg.inv(r), z) - (z**2).sum(axis=1)
    return float(-0.5 * (len(z) * logdet + q.sum()))


def ccc_garch(returns: np.ndarray) -> dict:
    z, vol, ll = _standardised(returns)
    r = np.corrcoef(z.T)
    return {"correlation": r, "loglik": ll + _correlation_loglik(z, r), "last_volatility": vol[-1]}


def dcc_garch(returns: np.ndarray) -> dict:
    z, vol, ll = _standardised(returns)
    qbar = z.T @ z / len(z)

    def run(a, b):
        q, total = qbar.copy(), 0.0
        for t in range(len(z)):
            if t:
                q = (1 - a - b) * qbar + a * np.outer(z[t - 1], z[t - 1]) + b * q
            d = np.sqrt(np.diag(q))
            r = q / np.outer(d, d)
            sign, logdet = np.linalg.slogdet(r)
            total -= 0.5 * (logdet + z[t] @ np.linalg.solve(r, z[t]) - z[t] @ z[t])
        return total, r

    x, nll, ok = nelder_mead(lambda t: 1e10 if t[0] < 0 or t[1] < 0 or t.sum() >= 0.9999 else -run(*t)[0], np.array([0.03, 0.9]), tol=1e-8, max_iter=200, restarts=0)
    return {"a": x[0], "b": x[1], "qbar": qbar, "loglik": ll - nll, "converged": ok, "correlation_last": run(*x)[1]}


def var_backtest(hits: np.ndarray, alpha: float = 0.05, dq_lags: int = 4) -> dict:
    """Coverage and independence with 0 ln 0 = 0, so series without a violation, or of nothing else, are tested too.

    Where violations are too few to part the lags (none among them), ``dq`` is not identified and NaN; ``p_dq`` is then that of the projection on what the
    lags span, with its rank for degrees of freedom.
    """
    h = hits.astype(float)
    n, v = len(h), int(h.sum())
    if n <= 2 * (dq_lags + 1):
        raise ValueError(f"{n} forecasts are too few for {dq_lags} lags")
    xl = lambda k, p: k * math.log(p) if k else 0.0
    p = v / n
    uc = 2 * (xl(v, p) + xl(n - v, 1 - p) - xl(v, alpha) - xl(n - v, 1 - alpha))
    a, b = h[:-1], h[1:]
    n00, n01, n10, n11 = (int(((a == i) & (b == j)).sum()) for i in (0, 1) for j in (0, 1))
    p01, p11, p2 = n01 / max(1, n00 + n01), n11 / max(1, n10 + n11), (n01 + n11) / (n - 1)
    ind = 2 * (xl(n00, 1 - p01) + xl(n01, p01) + xl(n10, 1 - p11) + xl(n11, p11) - xl(n00 + n10, 1 - p2) - xl(n01 + n11, p2))
    x = np.column_stack([np.ones(n - dq_lags)] + [h[dq_lags - j : n - j] - alpha for j in range(1, dq_lags + 1)])
    y = h[dq_lags:] - alpha
    fit = x @ np.linalg.lstsq(x, y, rcond=None)[0]
    rank = int(np.linalg.matrix_rank(x))
    dq = fit @ fit / (alpha * (1 - alpha))
    return {"n": n, "alpha": alpha, "n_violations": v, "expected_violations": alpha * n, "hit_rate": p, "lr_uc": uc, "p_uc": S.chi2_sf(uc, 1), "n00": n00, "n01": n01, "n10": n10, "n11": n11, "pi01": p01, "pi11": p11, "lr_ind": ind, "p_ind": S.chi2_sf(ind, 1), "lr_cc": uc + ind, "p_cc": S.chi2_sf(uc + ind, 2), "dq": dq if rank == dq_lags + 1 else math.nan, "p_dq": S.chi2_sf(dq, rank)}


def gpd_loglik(x: np.ndarray, xi: float, beta: float) -> float:
    if beta <= 0:
        return -np.inf
    if abs(xi) < 1e-9:
        return float(-len(x) * math.log(beta) - x.sum() / beta)
    u = 1 + xi * x / beta
    return -np.inf if (u <= 0).any() else float(-len(x) * math.log(beta) - (1 + 1 / xi) * np.log(u).sum())


def gpd_fit(y: np.ndarray, threshold: float | None = None, quantile: float = 0.90, p_tail: float | None = None) -> dict:
    u = float(np.quantile(y, quantile)) if threshold is None else threshold
    x = y[y > u] - u
    if len(x) < 10:
        raise ValueError("fewer than ten values over the threshold")
    s = x.mean()
    t, nll, ok = minimise(lambda t: 1e10 if not np.isfinite(v := gpd_loglik(x / s, t[0], t[1])) else -v, np.array([0.1, 0.9]))
    xi, beta = t[0], t[1] * s
    cov = np.linalg.pinv(hessian(lambda t: -gpd_loglik(x / s, t[0], t[1]), t)) if xi > -0.5 else np.full((2, 2), np.nan)
    se = np.sqrt(np.abs(np.diag(cov)))
    out = {"threshold": u, "threshold_quantile": quantile, "n": len(y), "n_exceed": len(x), "exceed_rate": len(x) / len(y), "xi": xi, "beta": beta, "se_xi": se[0], "se_beta": se[1] * s, "se_valid": float(xi > -0.5), "loglik": gpd_loglik(x, xi, beta), "converged": float(ok)}
    if p_tail is not None:
        ratio = p_tail / out["exceed_rate"]
        var = u + (beta / xi * (ratio**-xi - 1) if abs(xi) > 1e-9 else -beta * math.log(ratio))
        out |= {"p_tail": p_tail, "var": var, "es": (var + beta - xi * u) / (1 - xi) if xi < 1 else None}
    return out


def gev_loglik(x: np.ndarray, xi: float, mu: float, sigma: float) -> float:
    if sigma <= 0:
        return -np.inf
    z = (x - mu) / sigma
    if abs(xi) < 1e-8:
        return float(-len(x) * math.log(sigma) - z.sum() - np.exp(-z).sum())
    u = 1 + xi * z
    return -np.inf if (u <= 0).any() else float(-len(x) * math.log(sigma) - (1 + 1 / xi) * np.log(u).sum() - (u ** (-1 / xi)).sum())


def gev_fit(y: np.ndarray, block_size: int | None = None, return_periods: list | None = None) -> dict:
    x = y[: len(y) // block_size * block_size].reshape(-1, block_size).max(axis=1) if block_size else y
    m, s = x.mean(), x.std() or 1.0
    z = (x - m) / s
    t, nll, ok = minimise(lambda t: 1e10 if not np.isfinite(v := gev_loglik(z, *t)) else -v, np.array([0.05, -0.45, 0.78]))
    cov = np.linalg.pinv(hessian(lambda t: -gev_loglik(z, *t), t)) if t[0] > -0.5 else np.full((3, 3), np.nan)
    se = np.sqrt(np.abs(np.diag(cov)))
    xi, mu, sigma = t[0], t[1] * s + m, t[2] * s
    periods = return_periods or [10, 50, 100]
    level = lambda p: mu - sigma / xi * (1 - (-math.log(1 - 1 / p)) ** -xi) if abs(xi) > 1e-9 else mu - sigma * math.log(-math.log(1 - 1 / p))
    return {"xi": xi, "mu": mu, "sigma": sigma, "se_xi": se[0], "se_mu": se[1] * s, "se_sigma": se[2] * s, "se_valid": float(xi > -0.5), "loglik": gev_loglik(x, xi, mu, sigma), "converged": float(ok), "n_maxima": len(x), "block_size": block_size, "return_periods": periods, "return_levels": [level(p) for p in periods]}


def kendall_tau(u: np.ndarray) -> float:
    a, b = np.sign(u[:, 0][:, None] - u[:, 0]), np.sign(u[:, 1][:, None] - u[:, 1])
    i = np.triu_indices(len(u), 1)
    x, y = a[i], b[i]
    return float((x * y).sum() / math.sqrt((x != 0).sum() * (y != 0).sum()))


def copula_logpdf(u: np.ndarray, family: str, theta: np.ndarray) -> np.ndarray:
    x, y = u[:, 0], u[:, 1]
    t = theta[0]
    if family == "gaussian":
        a, b = (np.array([S.norm_ppf(v) for v in c]) for c in (x, y))
        return -0.5 * math.log(1 - t * t) - (t * t * (a * a + b * b) - 2 * t * a * b) / (2 * (1 - t * t))
    if family == "t":
        nu = theta[1]
        a, b = (np.array([S.t_ppf(v, nu) for v in c]) for c in (x, y))
        q = (a * a + b * b - 2 * t * a * b) / (1 - t * t)
        c = math.lgamma((nu + 2) / 2) + math.lgamma(nu / 2) - 2 * math.lgamma((nu + 1) / 2) - 0.5 * math.log(1 - t * t)
        return c - (nu + 2) / 2 * np.log1p(q / nu) + (nu + 1) / 2 * (np.log1p(a * a / nu) + np.log1p(b * b / nu))
    if family == "clayton":
        s = x**-t + y**-t - 1
        return math.log(1 + t) - (1 + t) * (np.log(x) + np.log(y)) - (2 + 1 / t) * np.log(s)
    if family == "gumbel":
        a, b = -np.log(x), -np.log(y)
        s = a**t + b**t
        c = s ** (1 / t)
        return -c + a + b + (t - 1) * (np.log(a) + np.log(b)) + (2 / t - 2) * np.log(s) + np.log1p((t - 1) * s ** (-1 / t))
    if family == "frank":
        e = -np.expm1(-t)
        d = e - (-np.expm1(-t * x)) * (-np.expm1(-t * y))
        return np.log(np.abs(t * e)) - t * (x + y) - 2 * np.log(np.abs(d))
    raise ValueError(f"family {family!r}: gaussian, t, clayton, gumbel or frank")


def _debye(t: float) -> float:
    s = (np.arange(2000) + 0.5) / 2000 * abs(t)
    d = float((s / np.expm1(s)).mean())
    return d if t > 0 else d + abs(t) / 2


def tau_to_param(tau: float, family: str) -> float:
    if family in ("gaussian", "t"):
        return math.sin(math.pi * tau / 2)
    if family in ("clayton", "gumbel") and tau <= 0:
        raise ValueError(f"{family} needs a positive rank correlation")
    if family == "clayton":
        return 2 * tau / (1 - tau)
    if family == "gumbel":
        return 1 / (1 - tau)
    low, high = -60.0, 60.0
    for _ in range(80):
        mid = (low + high) / 2
        if (0.0 if mid == 0 else 1 - 4 / mid * (1 - _debye(mid))) < tau:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def tail_dependence(family: str, theta: np.ndarray) -> tuple[float, float]:
    t = theta[0]
    if family == "clayton":
        return 2 ** (-1 / t), 0.0
    if family == "gumbel":
        return 0.0, 2 - 2 ** (1 / t)
    if family == "t":
        nu = theta[1]
        v = 2 * S.t_cdf(-math.sqrt((nu + 1) * (1 - t) / (1 + t)), nu + 1)
        return v, v
    return 0.0, 0.0


def copula_fit(u: np.ndarray, family: str = "gaussian", method: str = "mle") -> dict:
    if len(u) < 20:
        raise ValueError("fewer than twenty pairs")
    tau = kendall_tau(u)
    start = tau_to_param(tau, family)
    theta = np.array([start] + ([6.0] if family == "t" else []))
    bounds = {"gaussian": (-0.999, 0.999), "t": (-0.999, 0.999), "clayton": (1e-4, 60), "gumbel": (1.0001, 60), "frank": (-60, 60)}[family]
    theta[0] = min(max(theta[0], bounds[0] + 1e-3), bounds[1] - 1e-3)

    def nll(t, fixed=None):
        full = np.append(fixed, t) if fixed is not None else t
        if not bounds[0] <= full[0] <= bounds[1] or (len(full) > 1 and not 2.05 < full[1] < 100):
            return 1e10
        v = -copula_logpdf(u, family, full).sum()
        return v if np.isfinite(v) else 1e10

    ok = True
    if method == "mle":
        theta, value, ok = nelder_mead(nll, theta, step=0.1, tol=1e-9, max_iter=300, restarts=0)
    elif family == "t":
        nu, value, ok = nelder_mead(lambda t: nll(t, theta[:1]), theta[1:], tol=1e-9, max_iter=200, restarts=0)
        theta = np.append(theta[:1], nu)
    ll = -nll(theta)
    low, up = tail_dependence(family, theta)
    k = len(theta)
    return {"family": family, "method": method, "params": theta, "kendall_tau": tau, "loglik": ll, "aic": 2 * k - 2 * ll, "bic": k * math.log(len(u)) - 2 * ll, "lambda_lower": low, "lambda_upper": up, "n": len(u), "converged": float(ok)}


def copula_select(u: np.ndarray, families: list | None = None, method: str = "mle") -> dict:
    fits, skipped = [], []
    for f in families or ["gaussian", "t", "clayton", "gumbel", "frank"]:
        try:
            fits.append(copula_fit(u, f, method))
        except ValueError as e:
            skipped.append(f"{f}: {e}")
    by = lambda k: [f["family"] for f in sorted(fits, key=lambda f: f[k])]
    return {"fits": fits, "skipped": skipped or None, "best_aic": by("aic")[0], "best_bic": by("bic")[0], "ranking_aic": by("aic"), "ranking_bic": by("bic")}


