"""Forecasts, penalised regressions, mixed frequencies, term structure, predictive regressions, resampling."""

from __future__ import annotations

import math

import numpy as np

from . import special as S
from .linear import fit_table, ols
from .optim import bfgs, golden, nelder_mead
from .spectest import robust_wald


def _ses(x: np.ndarray, alpha: float) -> tuple[float, float]:
    """(sum of squared one-step errors, last level) with the first value as the first level."""
    level, total = x[0], 0.0
    for v in x[1:]:
        e = v - level
        total += e * e
        level += alpha * e
    return total, level


def theta_forecast(y: np.ndarray, steps: int = 8, period: int = 1) -> dict:
    n = len(y)
    season, multiplicative = None, False
    x = y
    if period > 1:
        if n < 2 * period:
            raise ValueError("the series must have two whole periods")
        w = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
        trend = np.convolve(y, w, "valid")
        lead = len(w) // 2
        multiplicative = bool((y > 0).all())
        mid = y[lead : lead + len(trend)]
        ratio = mid / trend if multiplicative else mid - trend
        season = np.array([ratio[(np.arange(len(ratio)) + lead) % period == j].mean() for j in range(period)])
        season = season / season.mean() if multiplicative else season - season.mean()
        full = season[np.arange(n) % period]
        x = y / full if multiplicative else y - full
    t = np.arange(n)
    b0 = ((t - t.mean()) @ (x - x.mean())) / ((t - t.mean()) ** 2).sum()
    grid = np.linspace(0.01, 0.99, 50)
    i = int(np.argmin([_ses(x, a)[0] for a in grid]))
    alpha = golden(lambda a: _ses(x, a)[0], max(1e-4, grid[max(0, i - 1)]), min(0.9999, grid[min(49, i + 1)]))
    level = _ses(x, alpha)[1]
    h = np.arange(1, steps + 1)
    f = level + 0.5 * b0 * (h - 1 + 1 / alpha - (1 - alpha) ** n / alpha)
    if season is not None:
        s = season[(n + h - 1) % period]
        f = f * s if multiplicative else f + s
    return {"forecast": f, "alpha": alpha, "drift": 0.5 * b0}


def har_rv(rv: np.ndarray, start: int = 22, variant: str = "level", hac_maxlags: int = 5, use_correction: bool = True) -> dict:
    x = {"level": rv, "log": np.log(np.maximum(rv, 1e-300)), "sqrt": np.sqrt(rv)}[variant]
    t = np.arange(start + 1, len(x))
    c = np.concatenate([[0.0], np.cumsum(x)])
    design = np.column_stack([np.ones(len(t)), x[t - 1], (c[t - 1] - c[t - 6]) / 5, (c[t - 1] - c[t - 23]) / 22])
    f = fit_table(x[t], design, "hac", hac_maxlags, use_correction)
    return {"params": f["params"], "bse": f["bse"], "tvalues": f["tvalues"], "rsquared": f["rsquared"], "nobs": len(t)}


def ridge(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> dict:
    return {"coef": np.linalg.solve(x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y)}


def coordinate_descent(gram: np.ndarray, xy: np.ndarray, l1: float, l2: float, tol: float, max_iter: int, start: np.ndarray | None = None) -> tuple[np.ndarray, int, float]:
    """Minimises b'Gb/2 - b'xy + l1 |b| + l2 b'b/2 on the Gram matrix: no pass over rows."""
    b = np.zeros(len(xy)) if start is None else start.copy()
    grad = xy - gram @ b
    moved = 0.0
    for it in range(1, max_iter + 1):
        moved = 0.0
        for j in range(len(b)):
            if gram[j, j] == 0:
                continue
            r = grad[j] + gram[j, j] * b[j]
            new = math.copysign(max(abs(r) - l1, 0.0), r) / (gram[j, j] + l2)
            if new != b[j]:
                grad -= gram[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]))
                b[j] = new
        if moved <= tol * max(1e-300, np.abs(b).max()):
            return b, it, moved
    return b, max_iter, moved


def elastic_net(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, l1_ratio: float = 0.5, tol: float = 1e-8, max_iter: int = 100_000) -> dict:
    n = len(y)
    b, it, moved = coordinate_descent(x.T @ x / n, x.T @ y / n, alpha * l1_ratio, alpha * (1 - l1_ratio), tol, max_iter)
    return {"coef": b, "n_iter": it, "max_change": moved, "max_rel_change": moved / max(np.abs(b).max(), 1e-300)}


def lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, tol: float = 1e-8, max_iter: int = 100_000) -> dict:
    return elastic_net(x, y, alpha, 1.0, tol, max_iter)


def adaptive_lasso(x: np.ndarray, y: np.ndarray, alpha: float = 0.1, l1_ratio: float = 1.0, gamma: float = 1.0, tol: float = 1e-7, max_iter: int = 100_000) -> dict:
    w = np.abs(np.linalg.lstsq(x, y, rcond=None)[0]) ** gamma
    f = elastic_net(x * w, y, alpha, l1_ratio, tol, max_iter)
    return f | {"coef": f["coef"] * w}


def lasso_path(x: np.ndarray, y: np.ndarray, l1_ratio: float = 1.0, n_lambdas: int = 100, eps: float = 1e-3, tol: float = 1e-7, max_iter: int = 100_000) -> dict:
    n = len(y)
    gram, xy, yy = x.T @ x / n, x.T @ y / n, y @ y
    top = np.abs(xy).max() / max(l1_ratio, 1e-3)
    lambdas = top * np.exp(np.linspace(0, math.log(eps), n_lambdas))
    b, coefs, rss = None, [], []
    for lam in lambdas:
        b, _, _ = coordinate_descent(gram, xy, lam * l1_ratio, lam * (1 - l1_ratio), tol, max_iter, b)
        coefs.append(b)
        rss.append(max(yy - 2 * n * b @ xy + n * b @ gram @ b, 1e-300))
    coefs, rss = np.array(coefs), np.array(rss)
    df = (coefs != 0).sum(axis=1)
    aic, bic = n * np.log(rss / n) + 2 * df, n * np.log(rss / n) + math.log(n) * df
    return {"lambdas": lambdas, "coefs": coefs, "rss": rss, "df": df, "aic": aic, "bic": bic, "aic_best": int(np.argmin(aic)), "bic_best": int(np.argmin(bic))}


# --- mixed frequencies


def midas_weights(scheme: str, a: float, b: float, k: int) -> np.ndarray:
    j = np.arange(1, k + 1)
    if scheme == "exp_almon":
        e = a * j + b * j**2
        w = np.exp(e - e.max())
    else:
        u = np.clip((j - 1) / max(k - 1, 1), 2.0**-52, 1 - 2.0**-52)
        w = u ** (a - 1) * (1 - u) ** (b - 1)
    return w / w.sum()


def umidas(y: np.ndarray, hf: np.ndarray, se_type: str = "hac", maxlags: int | None = None) -> dict:
    f = fit_table(y, np.column_stack([np.ones(len(y)), hf]), se_type, maxlags)
    return {"params": f["params"], "bse": f["bse"], "rsquared": f["rsquared"]}


def weighted_midas(y: np.ndarray, hf: np.ndarray, scheme: str = "exp_almon", weight_start: tuple | None = None) -> dict:
    k = hf.shape[1]

    def concentrated(t):
        w = midas_weights(scheme, t[0], t[1], k)
        x = np.column_stack([np.ones(len(y)), hf @ w])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        return ((y - x @ b) ** 2).sum(), b, w, x

    def objective(t):
        if scheme == "beta" and min(t) <= 0.01 or np.abs(t).max() > 50:
            return 1e15
        return concentrated(t)[0]

    starts = [weight_start] if weight_start else ([(0.0, -0.05), (0.1, -0.01), (-0.3, 0.0)] if scheme == "exp_almon" else [(1.0, 5.0), (1.5, 3.0)])
    t, ssr, ok = min((nelder_mead(objective, np.array(s, float)) for s in starts), key=lambda r: r[1])
    ssr, b, w, x = concentrated(t)
    return {"scheme": scheme, "intercept": b[0], "slope": b[1], "weight_params": t, "weights": w, "fitted": x @ b, "residuals": y - x @ b, "ssr": ssr, "rsquared": 1 - ssr / ((y - y.mean()) ** 2).sum(), "converged": float(ok)}


# --- nowcasting: a factor model with missing cells


def _factor_smoother(z: np.ndarray, load: np.ndarray, a: list, q: np.ndarray, r: np.ndarray):
    """Kalman smoother of z_t = load f_t + e, f a VAR; returns (smoothed factors, log likelihood)."""
    k, p = load.shape[1], len(a)
    m = k * p
    t = np.zeros((m, m))
    t[:k] = np.hstack(a)
    t[k:, :-k] = np.eye(m - k)
    qq = np.zeros((m, m))
    qq[:k, :k] = q
    state, var = np.zeros(m), np.linalg.lstsq(np.eye(m * m) - np.kron(t, t), qq.ravel(), rcond=None)[0].reshape(m, m)
    h = np.hstack([load, np.zeros((len(load), m - k))])
    preds, pvars, filts, fvars, ll = [], [], [], [], 0.0
    for row in z:
        preds.append(state)
        pvars.append(var)
        s, v = state, var
        for i in np.flatnonzero(~np.isnan(row)):
            f = h[i] @ v @ h[i] + r[i]
            e = row[i] - h[i] @ s
            g = v @ h[i] / f
            s, v = s + g * e, v - np.outer(g, g) * f
            ll += -0.5 * (math.log(2 * math.pi * f) + e * e / f)
        filts.append(s)
        fvars.append(v)
        state, var = t @ s, t @ v @ t.T + qq
    sm = [filts[-1]]
    for i in range(len(z) - 2, -1, -1):
        c = fvars[i] @ t.T @ np.linalg.pinv(pvars[i + 1])
        sm.append(filts[i] + c @ (sm[-1] - preds[i + 1]))
    return np.array(sm[::-1])[:, :k], ll


def _two_step(data: np.ndarray, n_factors: int, order: int):
    from .varmodels import Var, _signed

    full = ~np.isnan(data).any(axis=1)
    block = data[: int(np.argmin(full)) if not full.all() else len(data)]
    centre, scale = block.mean(axis=0), block.std(axis=0)
    z = (block - centre) / scale
    w, v = np.linalg.eigh(z.T @ z / len(z))
    load = _signed(v[:, np.argsort(-w)[:n_factors]])
    f = z @ load
    r = ((z - f @ load.T) ** 2).mean(axis=0)
    var = Var(f, order, "n")
    return centre, scale, load, var.a, var.sigma_ml, np.maximum(r, 1e-6)


def dfm_nowcast(data: np.ndarray, n_factors: int = 1, factor_order: int = 2) -> dict:
    """Principal components of the leading balanced block, their VAR, then the Kalman smoother over the ragged panel."""
    centre, scale, load, a, q, r = _two_step(data, n_factors, factor_order)
    f, ll = _factor_smoother((data - centre) / scale, load, a, q, r)
    return {"nowcast": centre + scale * (load @ f[-1]), "edge_factor": f[-1], "loglik": ll, "smoothed_factors": f, "n_factors": n_factors, "factor_order": factor_order}


def dfm_news(old: np.ndarray, new: np.ndarray, target_series: int = 0, target_period: int | None = None, n_factors: int = 1, factor_order: int = 2) -> dict:
    """What each newly observed cell adds to the nowcast, at the old vintage's parameters: the smoother is linear in the data."""
    centre, scale, load, a, q, r = _two_step(old, n_factors, factor_order)
    at = len(new) - 1 if target_period is None else target_period
    pad = np.vstack([old, np.full((len(new) - len(old), old.shape[1]), np.nan)]) if len(new) > len(old) else old
    smooth = lambda d: _factor_smoother((d - centre) / scale, load, a, q, r)[0]
    value = lambda f: float(centre[target_series] + scale[target_series] * (load[target_series] @ f[at]))
    before = smooth(pad)
    cells = [(t, i) for t, i in zip(*np.nonzero(~np.isnan(new) & np.isnan(pad)), strict=True)]
    expected = {c: centre[c[1]] + scale[c[1]] * (load[c[1]] @ before[c[0]]) for c in cells}
    base = np.where(np.isnan(pad), np.nan, pad)
    filled = base.copy()
    for c in cells:
        filled[c] = expected[c]
    start, rows = value(smooth(filled)), []
    for c in cells:
        moved = filled.copy()
        moved[c] += scale[c[1]]
        weight = (value(smooth(moved)) - start) / scale[c[1]]
        news = new[c] - expected[c]
        rows.append({"series": float(c[1]), "period": float(c[0]), "actual": new[c], "forecast": expected[c], "news": news, "weight": weight, "contribution": weight * news})
    end = filled.copy()
    for c in cells:
        end[c] = new[c]
    return {"target_series": target_series, "target_period": at, "old_nowcast": value(before), "new_nowcast": value(smooth(end)), "total_revision": value(smooth(end)) - value(before), "contributions": rows or None}


# --- term structure


def ns_loadings(m: np.ndarray, decay: float) -> np.ndarray:
    x = decay * np.asarray(m, float)
    s = np.where(x < 1e-8, 1 - x / 2, -np.expm1(-x) / np.where(x == 0, 1, x))
    return np.column_stack([np.ones(len(x)), s, s - np.exp(-x)])


def nelson_siegel(maturities: np.ndarray, yields: np.ndarray, decay: float = 0.0609, optimal_lambda: bool = False) -> dict:
    def ssr(d):
        x = ns_loadings(maturities, d)
        b = np.linalg.lstsq(x, yields, rcond=None)[0]
        return ((yields - x @ b) ** 2).sum()

    if optimal_lambda:
        grid = np.exp(np.linspace(math.log(0.005), math.log(2.0), 60))
        i = int(np.argmin([ssr(g) for g in grid]))
        decay = golden(ssr, grid[max(0, i - 1)], grid[min(59, i + 1)])
    x = ns_loadings(maturities, decay)
    b, u, _ = ols(yields, x)
    return {"level": b[0], "slope": b[1], "curvature": b[2], "factors": b, "lambda": decay, "residuals": u, "rsquared": 1 - u @ u / ((yields - yields.mean()) ** 2).sum()}


def svensson(maturities: np.ndarray, yields: np.ndarray, lambda1: float = 0.0609, lambda2: float = 0.3) -> dict:
    x = np.column_stack([ns_loadings(maturities, lambda1), ns_loadings(maturities, lambda2)[:, 2]])
    b, u, _ = ols(yields, x)
    return {"factors": b, "lambda1": lambda1, "lambda2": lambda2, "residuals": u, "rsquared": 1 - u @ u / ((yields - yields.mean()) ** 2).sum()}


def dynamic_ns(panel: np.ndarray, maturities: list, decay: float = 0.0609) -> dict:
    x = ns_loadings(np.array(maturities, float), decay)
    f = np.linalg.lstsq(x, panel.T, rcond=None)[0].T
    slope, icpt, nxt = [], [], []
    for j in range(3):
        b, _, _ = ols(f[1:, j], np.column_stack([np.ones(len(f) - 1), f[:-1, j]]))
        icpt.append(b[0])
        slope.append(b[1])
        nxt.append(b[0] + b[1] * f[-1, j])
    u = panel - f @ x.T
    return {"factors": f, "ar1_intercept": icpt, "ar1_phi": slope, "maturities": maturities, "lambda": decay, "rsquared": 1 - (u**2).sum() / ((panel - panel.mean(axis=0)) ** 2).sum(), "level": nxt[0], "slope": nxt[1], "curvature": nxt[2], "forecast": x @ np.array(nxt)}


def afns_adjustment(maturities: np.ndarray, sigma: list, decay: float = 0.0609) -> dict:
    """-C(t)/t for independent factors: half the average squared factor loading of the bond price, by Gauss-Legendre quadrature."""
    nodes, weights = np.polynomial.legendre.leggauss(40)
    out = []
    for t in np.asarray(maturities, float):
        s = (nodes + 1) / 2 * t
        b2 = -np.expm1(-decay * s) / decay
        b3 = b2 - s * np.exp(-decay * s)
        f = 0.5 * (sigma[0] ** 2 * s**2 + sigma[1] ** 2 * b2**2 + sigma[2] ** 2 * b3**2)
        out.append(-(weights @ f) / 2)
    return {"adjustment": out, "maturities": maturities}


def acm_term_premium(yields: np.ndarray, maturities: list, n_factors: int = 5, periods_per_year: float = 12.0) -> dict:
    """Factors, their VAR(1), excess-return regressions, prices of risk, then affine recursions with and without them."""
    m = np.asarray(maturities, int)
    t, _ = yields.shape
    x = (yields - yields.mean(axis=0)) / yields.std(axis=0)
    w, v = np.linalg.eigh(x.T @ x / t)
    load = v[:, np.argsort(-w)[:n_factors]]
    f = x @ load
    f = f / f.std(axis=0)
    z = np.column_stack([np.ones(t - 1), f[:-1]])
    b = np.linalg.lstsq(z, f[1:], rcond=None)[0]
    mu, phi = b[0], b[1:].T
    u = f[1:] - z @ b
    sigma = u.T @ u / len(u)
    per = yields / periods_per_year
    short = per[:, 0] / m[0] * m[0]
    pairs = [(i, j) for i, a in enumerate(m) for j, c in enumerate(m) if c == a - 1]
    if not pairs:
        raise ValueError("excess returns need maturities that are one period apart")
    rx = np.column_stack([m[i] * per[:-1, i] - m[j] * per[1:, j] - short[:-1] for i, j in pairs])
    design = np.column_stack([np.ones(t - 1), u, f[:-1]])
    c = np.linalg.lstsq(design, rx, rcond=None)[0]
    a, beta, cc = c[0], c[1 : 1 + n_factors], c[1 + n_factors :]
    e = rx - design @ c
    s2 = (e**2).mean()
    conv = np.array([beta[:, i] @ sigma @ beta[:, i] for i in range(len(pairs))])
    pinv = np.linalg.pinv(beta.T)
    lam0, lam1 = pinv @ (a + 0.5 * (conv + s2)), pinv @ cc.T
    d = np.linalg.lstsq(np.column_stack([np.ones(t), f]), short, rcond=None)[0]

    def recursion(l0, l1):
        aa, bb, fit = 0.0, np.zeros(n_factors), np.zeros((t, len(m)))
        for n in range(1, int(m.max()) + 1):
            aa, bb = aa + bb @ (mu - l0) + 0.5 * (bb @ sigma @ bb + s2) - d[0], bb @ (phi - l1) - d[1:]
            for k in np.flatnonzero(m == n):
                fit[:, k] = -(aa + f @ bb) / n * periods_per_year
        return fit

    fitted, neutral = recursion(lam0, lam1), recursion(np.zeros(n_factors), np.zeros((n_factors, n_factors)))
    return {"maturities": maturities, "n_factors": n_factors, "mu": mu, "phi": phi, "sigma": sigma, "lambda0": lam0, "lambda1": lam1, "delta0": d[0], "delta1": d[1:], "sigma2": s2, "fitted": fitted, "risk_neutral": neutral, "term_premium": fitted - neutral}


# --- predictive regressions


def _ivx(r: np.ndarray, xs: np.ndarray, cz: float, alpha: float):
    n = len(r)
    rz = 1 + cz / n**alpha
    dx = np.diff(xs, axis=0)
    z = np.zeros((n - 1, xs.shape[1]))
    for t in range(1, n - 1):
        z[t] = rz * z[t - 1] + dx[t - 1]
    y, x = r[1:], xs[:-1]
    yd, xd = y - y.mean(), x - x.mean(axis=0)
    u = yd - xd @ np.linalg.lstsq(xd, yd, rcond=None)[0]
    a = np.linalg.inv(z.T @ xd)
    b = a @ z.T @ yd
    s2 = u @ u / len(u)
    zz = z.T @ z - len(z) * np.outer(z.mean(axis=0), z.mean(axis=0))
    cov = s2 * a @ zz @ a.T
    return b, cov, rz


def predictive_regression(r: np.ndarray, x: np.ndarray, cz: float = -1.0, alpha: float = 0.95) -> dict:
    n = len(r) - 1
    f = fit_table(r[1:], np.column_stack([np.ones(n), x[:-1]]), "nonrobust")
    rho = fit_table(x[1:], np.column_stack([np.ones(n), x[:-1]]), "nonrobust")
    v, u = rho["resid"], f["resid"]
    phi = u @ v / (v @ v)
    bias = -phi * (1 + 3 * rho["params"][1]) / n
    b, cov, rz = _ivx(r, x[:, None], cz, alpha)
    wald = b[0] ** 2 / cov[0, 0]
    return {"ols": {"alpha": f["params"][0], "beta": f["params"][1], "se": f["bse"][1], "tstat": f["tvalues"][1]}, "stambaugh": {"beta_ols": f["params"][1], "beta_corrected": f["params"][1] - bias, "bias_term": bias, "rho_ols": rho["params"][1]}, "ivx": {"beta_ivx": b[0], "wald": wald, "pvalue": S.chi2_sf(wald, 1), "rz": rz}, "nobs": n}


def ivx_test(r: np.ndarray, xs: np.ndarray, cz: float = -1.0, alpha: float = 0.95, joint: str = "chi2") -> dict:
    k = xs.shape[1]
    b, cov, rz = _ivx(r, xs, cz, alpha)
    wald = b @ np.linalg.solve(cov, b)
    single = [(bb := _ivx(r, xs[:, [j]], cz, alpha))[0][0] ** 2 / bb[1][0, 0] for j in range(k)]
    p = [S.chi2_sf(w, 1) for w in single]
    return {"beta_ivx": b, "rz": rz, "nregressors": k, "nobs": len(r) - 1, "wald": wald, "pvalue": S.chi2_sf(wald, k) if joint == "chi2" else min(1.0, k * min(p)), "wald_scalar": single, "pvalue_scalar": p, "joint": joint}


def recession_probit(y: np.ndarray, x: np.ndarray, link: str = "probit", dynamic: bool = False) -> dict:
    cdf = np.vectorize(S.norm_cdf) if link == "probit" else lambda v: 1 / (1 + np.exp(-v))

    def loglik(eta):
        p = np.clip(cdf(eta), 1e-12, 1 - 1e-12)
        return float((y * np.log(p) + (1 - y) * np.log1p(-p)).sum())

    k = x.shape[1]
    if not dynamic:
        b = np.zeros(k)
        ok = False
        for _ in range(100):
            eta = x @ b
            p = np.clip(cdf(eta), 1e-12, 1 - 1e-12)
            d = S.norm_pdf(eta) if link == "probit" else p * (1 - p)
            w = d**2 / (p * (1 - p))
            g = x.T @ (d * (y - p) / (p * (1 - p)))
            h = x.T @ (x * w[:, None])
            step = np.linalg.solve(h, g)
            b = b + step
            if np.abs(step).max() < 1e-10:
                ok = True
                break
        if link == "probit":
            eta = x @ b
            q = 2 * y - 1
            m = q * S.norm_pdf(q * eta) / np.clip(cdf(q * eta), 1e-12, 1)
            h = x.T @ (x * (m * (m + eta))[:, None])
        se = np.sqrt(np.diag(np.linalg.inv(h)))
        eta = x @ b
        extra = {}
    else:
        def index(t):
            e, prev = np.zeros(len(y)), 0.0
            for i in range(len(y)):
                prev = x[i] @ t[:k] + t[k] * prev
                e[i] = prev
            return e

        t, _, ok = nelder_mead(lambda t: 1e10 if abs(t[k]) >= 0.999 else -loglik(index(t)), np.append(recession_probit(y, x, link)["params"] * 0.5, 0.5))
        b, eta = t[:k], index(t)
        from .optim import hessian

        se = np.sqrt(np.abs(np.diag(np.linalg.pinv(hessian(lambda u: -loglik(index(u)), t)))))[:k]
        extra = {"rho": t[k]}
    ll = loglik(eta)
    base = y.mean()
    null = len(y) * (base * math.log(base) + (1 - base) * math.log(1 - base))
    return {"params": b, "bse": se, "zstats": b / se, "probabilities": cdf(eta), "loglik": ll, "pseudo_r2": 1 - ll / null, "converged": float(ok), **extra}


def cg_regression(errors: np.ndarray, revisions: np.ndarray, maxlags: int | None = None, use_correction: bool = True) -> dict:
    f = fit_table(errors, np.column_stack([np.ones(len(errors)), revisions]), "hac", maxlags, use_correction)
    b, s = f["params"], f["bse"]
    return {"intercept": b[0], "slope": b[1], "se_intercept": s[0], "se_slope": s[1], "t_slope": b[1] / s[1], "p_slope": 2 * S.norm_sf(abs(b[1] / s[1])), "r_squared": f["rsquared"], "implied_rigidity": b[1] / (1 + b[1]), "nobs": len(errors)}


def forecast_efficiency(errors: np.ndarray, regressors: np.ndarray, maxlags: int | None = None, use_correction: bool = True) -> dict:
    x = np.column_stack([np.ones(len(errors)), regressors])
    f = robust_wald(x, errors, maxlags, use_correction)
    return {"params": f["params"], "bse": f["bse"], "tvalues": f["tvalues"], "pvalues": [2 * S.norm_sf(abs(t)) for t in f["tvalues"]], "r_squared": f["rsquared"], "wald": f["wald"], "wald_df": f["wald_df"], "wald_pvalue": f["wald_pvalue"]}


def dsge_solve(a, b, c, n_predetermined: int) -> dict:
    """A E[x_{t+1}] = B x_t + C e_t with the predetermined variables first: eigenvalues of inv(A) B split at the unit circle."""
    a, b, c = (np.asarray(m, float) for m in (a, b, c))
    w = np.linalg.solve(a, b)
    lam, v = np.linalg.eig(w)
    order = np.argsort(np.abs(lam))
    lam, v = lam[order], v[:, order]
    stable, n = int((np.abs(lam) < 1).sum()), len(a)
    verdict = "Unique" if stable == n_predetermined else "Indeterminate" if stable > n_predetermined else "NoStableSolution"
    out: dict = {"eigenvalue_moduli": np.abs(lam), "verdict": verdict}
    if verdict == "Unique":
        v11, v21 = v[:n_predetermined, :n_predetermined], v[n_predetermined:, :n_predetermined]
        g = np.real(v21 @ np.linalg.inv(v11))
        p = np.real(v11 @ np.diag(lam[:n_predetermined]) @ np.linalg.inv(v11))
        out |= {"g": g, "p": p, "q": np.linalg.solve(a, c)[:n_predetermined]}
    return out


def gmm_nonlinear(moments_fn, initial, weight=None) -> dict:
    """Minimises the quadratic form of average moments; ``moments_fn(theta)`` gives rows of moments."""
    evals = 0

    def objective(t):
        nonlocal evals
        evals += 1
        g = np.asarray(moments_fn(t)).mean(axis=0)
        return float(g @ (np.eye(len(g)) if weight is None else weight) @ g)

    x, fx, ok = nelder_mead(objective, np.asarray(initial, float), tol=1e-14)
    y, fy, _ = bfgs(objective, x)
    x, fx = (y, fy) if fy < fx else (x, fx)
    g = np.asarray(moments_fn(x)).mean(axis=0)
    return {"params": x, "objective": fx, "gbar": g, "converged": float(ok), "fevals": evals, "nmoments": len(g), "nparams": len(x)}


# --- resampling


def philox_uniforms(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(n)


def _bounded(bits, n: int) -> int:
    """Masked rejection on 64-bit draws; a single outcome draws nothing."""
    if n == 1:
        return 0
    mask = (1 << (n - 1).bit_length()) - 1
    while True:
        v = int(bits.random_raw()) & mask
        if v < n:
            return v


def bootstrap_indices(n: int, scheme: str = "stationary", seed: int = 0, block_length: int | None = None, p: float | None = None, bits=None) -> np.ndarray:
    bits = bits or np.random.Philox(np.random.SeedSequence(seed))
    size = block_length or max(1, round(n ** (1 / 3)))
    out: list[int] = []
    if scheme == "iid":
        return np.array([_bounded(bits, n) for _ in range(n)])
    if scheme in ("moving", "circular"):
        while len(out) < n:
            s = _bounded(bits, n - size + 1 if scheme == "moving" else n)
            out += [(s + j) % n for j in range(size)]
        return np.array(out[:n])
    if scheme != "stationary":
        raise ValueError(f"scheme {scheme!r}: iid, moving, circular or stationary")
    p = p if p is not None else 1 / size
    at = _bounded(bits, n)
    for _ in range(n):
        out.append(at)
        u = (int(bits.random_raw()) >> 11) / 9007199254740992.0
        at = _bounded(bits, n) if u < p else (at + 1) % n
    return np.array(out)


def optimal_block_length(y: np.ndarray) -> dict:
    n = len(y)
    x = y - y.mean()
    kn = max(5, math.ceil(math.sqrt(math.log10(n))))
    top = math.ceil(math.sqrt(n)) + kn
    g = np.array([x[k:] @ x[: n - k] / n for k in range(min(top + 1, n))])
    rho = np.abs(g[1:] / g[0])
    bound = 2 * math.sqrt(math.log10(n) / n)
    m = next((k for k in range(1, len(rho) - kn + 1) if (rho[k - 1 : k - 1 + kn] < bound).all()), None)
    m = max(1, m - 1) if m is not None else (int(np.flatnonzero(rho > bound).max()) + 1 if (rho > bound).any() else 1)
    big = min(2 * m, len(g) - 1)
    k = np.arange(-big, big + 1)
    lam = np.where(np.abs(k / big) <= 0.5, 1.0, 2 * (1 - np.abs(k / big)))
    r = g[np.abs(k)]
    gg, spec = (lam * np.abs(k) * r).sum(), (lam * r).sum()
    cap = math.ceil(min(3 * math.sqrt(n), n / 3))
    size = lambda d: min((2 * gg**2 / d) ** (1 / 3) * n ** (1 / 3), cap)
    return {"stationary": size(2 * spec**2), "circular": size(4 / 3 * spec**2)}


