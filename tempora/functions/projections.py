"""Local projections and panels on arrays."""

from __future__ import annotations

import math

import numpy as np

from . import special as S
from .linear import fit_table, meat, ols


def lp_design(y: np.ndarray, shock: np.ndarray, h: int, p: int, augmented: bool, cumulative: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Target and [shock, constant, lags of y, lags of the shock] for t = start..n-1-h."""
    n = len(y)
    q = h if augmented else 0
    start = max(p, q)
    t = np.arange(start, n - h)
    sums = np.concatenate([[0.0], np.cumsum(y)])
    target = sums[t + h + 1] - sums[t] if cumulative else y[t + h]
    cols = [shock[t], np.ones(len(t))] + [y[t - j] for j in range(1, p + 1)] + [shock[t - j] for j in range(1, q + 1)]
    return target, np.column_stack(cols)


def lp(y: np.ndarray, shock: np.ndarray, horizons: int = 12, n_lag_controls: int = 4, se: str | None = None, maxlags: int | None = None, cumulative: str | None = None) -> dict:
    augmented = se == "lag_augmented"
    if augmented and cumulative == "both":
        raise ValueError("lag augmentation does not go with a cumulated impulse")
    irf, ses = [], []
    for h in range(horizons + 1):
        target, x = lp_design(y, shock, h, n_lag_controls, augmented, cumulative in ("outcome", "both"))
        f = fit_table(target, x, "hc1") if augmented else fit_table(target, x, "hac", h + n_lag_controls if maxlags is None else maxlags)
        irf.append(f["params"][0])
        ses.append(f["bse"][0])
    return {"horizons": np.arange(horizons + 1), "irf": irf, "se": ses, "se_method": "lag_augmented" if augmented else "hac"}


def two_stage(y: np.ndarray, x: np.ndarray, z: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, HAC covariance, first-stage F of the first regressor on the first instrument)."""
    pz = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    a = np.linalg.inv(pz.T @ x)
    b = a @ pz.T @ y
    u = y - x @ b
    cov = a @ meat(pz * u[:, None], lags) @ a.T
    f = fit_table(x[:, 0], z, "hac", lags)
    return b, cov, (f["params"][0] / f["bse"][0]) ** 2


def lp_iv(y: np.ndarray, impulse: np.ndarray, instrument: np.ndarray, horizons: int = 8, n_lag_controls: int = 4) -> dict:
    out = {"horizons": np.arange(horizons + 1), "irf": [], "se": [], "first_stage_f": []}
    for h in range(horizons + 1):
        target, x = lp_design(y, impulse, h, n_lag_controls, False)
        z = x.copy()
        z[:, 0] = instrument[n_lag_controls : len(y) - h]
        b, cov, f = two_stage(target, x, z, h + n_lag_controls)
        out["irf"].append(b[0])
        out["se"].append(math.sqrt(cov[0, 0]))
        out["first_stage_f"].append(f)
    return out


def lp_multiplier(y: np.ndarray, impulse: np.ndarray, instrument: np.ndarray, horizons: int = 20, n_lag_controls: int = 4, maxlags: int | None = None) -> dict:
    out = {"horizons": np.arange(horizons + 1), "multiplier": [], "se": [], "first_stage_f": [], "nobs_per_h": []}
    p, n = n_lag_controls, len(y)
    sy, si = (np.concatenate([[0.0], np.cumsum(v)]) for v in (y, impulse))
    for h in range(horizons + 1):
        t = np.arange(p, n - h)
        controls = [np.ones(len(t))] + [y[t - j] for j in range(1, p + 1)] + [impulse[t - j] for j in range(1, p + 1)]
        x = np.column_stack([si[t + h + 1] - si[t], *controls])
        z = np.column_stack([instrument[t], *controls])
        b, cov, f = two_stage(sy[t + h + 1] - sy[t], x, z, h + p if maxlags is None else maxlags)
        out["multiplier"].append(b[0])
        out["se"].append(math.sqrt(cov[0, 0]))
        out["first_stage_f"].append(f)
        out["nobs_per_h"].append(len(t))
    return out


def lp_state(y: np.ndarray, shock: np.ndarray, state: np.ndarray, horizons: int = 12, n_lag_controls: int = 4) -> dict:
    out = {"horizons": np.arange(horizons + 1), "irf_state1": [], "se_state1": [], "irf_state0": [], "se_state0": []}
    p = max(1, n_lag_controls)
    for h in range(horizons + 1):
        t = np.arange(p, len(y) - h)
        base = np.column_stack([shock[t], np.ones(len(t))] + [y[t - j] for j in range(1, n_lag_controls + 1)])
        i = state[t - 1][:, None]
        f = fit_table(y[t + h], np.hstack([base * i, base * (1 - i)]), "hac", h + n_lag_controls)
        k = base.shape[1]
        for name, at in (("1", 0), ("0", k)):
            out[f"irf_state{name}"].append(f["params"][at])
            out[f"se_state{name}"].append(f["bse"][at])
    return out


def bspline(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    b = np.array([(x >= knots[i] - 1e-12) & (x < knots[i + 1] - 1e-12) for i in range(len(knots) - 1)], float).T
    for d in range(1, degree + 1):
        new = np.zeros((len(x), len(knots) - 1 - d))
        for i in range(new.shape[1]):
            left, right = knots[i + d] - knots[i], knots[i + d + 1] - knots[i + 1]
            new[:, i] = ((x - knots[i]) / left * b[:, i] if left else 0) + ((knots[i + d + 1] - x) / right * b[:, i + 1] if right else 0)
        b = new
    return b


def smooth_lp(y: np.ndarray, shock: np.ndarray, horizons: int = 12, n_lag_controls: int = 4, lam: float | None = None, degree: int = 3, n_basis: int | None = None, penalty_order: int = 2, lambda_grid: list | None = None, n_folds: int = 5, hac_maxlags: int | None = None) -> dict:
    """Impulse responses as a penalised B-spline over horizons, after controls are partialled out at each horizon."""
    hs = np.arange(horizons + 1)
    n_basis = n_basis or horizons + 1
    step = horizons / (n_basis - degree)
    knots = step * np.arange(-degree, n_basis + 1, dtype=float)
    basis = bspline(hs.astype(float), knots, degree)
    xx, xy, rows, raw, raw_se = np.zeros(horizons + 1), np.zeros(horizons + 1), [], [], []
    for h in hs:
        target, x = lp_design(y, shock, h, n_lag_controls, False)
        c = x[:, 1:]
        s, r = (v - c @ np.linalg.lstsq(c, v, rcond=None)[0] for v in (x[:, 0], target))
        xx[h], xy[h] = s @ s, s @ r
        rows.append((s, r))
        f = fit_table(target, x, "hac", h + n_lag_controls)
        raw.append(f["params"][0])
        raw_se.append(f["bse"][0])
    k = basis.shape[1]
    d = np.diff(np.eye(k), penalty_order, axis=0)
    penalty = d.T @ d
    gram, rhs = basis.T @ (basis * xx[:, None]), basis.T @ xy
    scale = np.trace(gram) / k
    grid = np.array(lambda_grid) if lambda_grid is not None else scale * 10.0 ** np.linspace(-4, 4, 17)
    scores = []
    if lam is None:
        n = len(y)
        edges = np.linspace(n_lag_controls, n, n_folds + 1).astype(int)
        for g in grid:
            loss = 0.0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                gx, gy = np.zeros(horizons + 1), np.zeros(horizons + 1)
                held = []
                for h in hs:
                    s, r = rows[h]
                    t = np.arange(n_lag_controls, n_lag_controls + len(s))
                    out = (t >= a - h) & (t < b)
                    gx[h], gy[h] = (s[~out] ** 2).sum(), (s[~out] * r[~out]).sum()
                    inside = (t >= a) & (t < b)
                    held.append((s[inside], r[inside]))
                theta = np.linalg.lstsq(basis.T @ (basis * gx[:, None]) + g * penalty, basis.T @ gy, rcond=None)[0]
                fit = basis @ theta
                loss += sum(((r - fit[h] * s) ** 2).sum() for h, (s, r) in enumerate(held))
            scores.append(loss)
        lam = float(grid[int(np.argmin(scores))])
    inv = np.linalg.pinv(gram + lam * penalty)
    theta = inv @ rhs
    irf = basis @ theta
    n = len(rows[0][0])
    score = np.zeros((n, k))
    for h in hs:
        s, r = rows[h]
        score[: len(s)] += (s * (r - irf[h] * s))[:, None] * basis[h]
    cov = inv @ meat(score, horizons + n_lag_controls if hac_maxlags is None else hac_maxlags) @ inv
    return {"horizons": hs, "irf": irf, "se": np.sqrt(np.maximum(np.einsum("hi,ij,hj->h", basis, cov, basis), 0)), "lambda_used": lam, "cv_grid": grid, "cv_scores": scores or None, "theta": theta, "irf_raw": raw, "se_raw": raw_se}


def quantile_lp(y: np.ndarray, shock: np.ndarray, taus: list | None = None, horizons: int = 12, n_lag_controls: int = 4) -> dict:
    from .spectest import quantile_regression

    taus = taus or [0.1, 0.5, 0.9]
    irf, se = [], []
    for h in range(horizons + 1):
        q = quantile_regression(*lp_design(y, shock, h, n_lag_controls, False), taus)
        irf.append(q["params"][:, 0])
        se.append(q["bse"][:, 0])
    return {"taus": taus, "horizons": np.arange(horizons + 1), "irf": np.array(irf).T, "se": np.array(se).T}


def flp(y: np.ndarray, scores: np.ndarray, horizons: int = 8, n_lag_controls: int = 2, hac_maxlags: int | None = None) -> dict:
    k, p = scores.shape[1], n_lag_controls
    betas, covs, n = [], [], []
    for h in range(horizons + 1):
        t = np.arange(p, len(y) - h)
        x = np.column_stack([scores[t], np.ones(len(t))] + [y[t - j] for j in range(1, p + 1)])
        f = fit_table(y[t + h], x, "hac", h + p if hac_maxlags is None else hac_maxlags)
        betas.append(f["params"][:k])
        covs.append(f["cov"][:k, :k])
        n.append(len(t))
    return {"horizons": np.arange(horizons + 1), "n_factors": k, "betas": np.array(betas), "covs": np.array(covs), "se": np.sqrt(np.array([np.diag(c) for c in covs])), "nobs": n}


def flp_scenario(y: np.ndarray, curves: np.ndarray, delta: list, n_factors: int = 3, horizons: int = 8, n_lag_controls: int = 2) -> dict:
    from .varmodels import functional_pca

    f = functional_pca(curves, n_factors)
    w = f["eigenfunctions"].T @ np.asarray(delta, float)
    fit = flp(y, f["scores"], horizons, n_lag_controls)
    return {"horizons": fit["horizons"], "weights": w, "response": fit["betas"] @ w, "se": np.sqrt(np.einsum("i,hij,j->h", w, fit["covs"], w)), "betas": fit["betas"], "explained": f["explained"]}


def fvar_scenario(y: np.ndarray, curves: np.ndarray, delta: list, n_factors: int = 3, lags: int = 2, horizon: int = 10) -> dict:
    from .varmodels import Var, functional_pca

    f = functional_pca(curves, n_factors)
    w = f["eigenfunctions"].T @ np.asarray(delta, float)
    v = Var(np.column_stack([f["scores"], y]), lags)
    s = v.sigma
    implied = s[-1, :-1] @ np.linalg.solve(s[:-1, :-1], w)
    r = v.psi(horizon) @ np.append(w, 0.0)
    return {"horizons": np.arange(horizon + 1), "weights": w, "response_outcome": r[:, -1], "responses": r, "implied_outcome_innovation": implied}


# --- panels: arrays are (unit, time)


def _within(v: np.ndarray) -> np.ndarray:
    return v - v.mean(axis=1, keepdims=True)


def panel_cov(x: np.ndarray, u: np.ndarray, inv: np.ndarray, se_type: str, bandwidth: float) -> np.ndarray:
    """x is (k, unit, time), u is (unit, time)."""
    k, n, t = x.shape
    if se_type == "nonrobust":
        return inv * (u**2).sum() / (n * t - k - n)
    s = x * u
    if se_type == "cluster":
        g = s.sum(axis=2)
        return inv @ (g @ g.T) @ inv * (n / (n - 1)) * (n * t - 1) / (n * t - k)
    g = s.sum(axis=1).T
    return inv @ meat(g, int(bandwidth)) @ inv


def panel_fe(outcome: np.ndarray, regressors: np.ndarray, se_type: str = "cluster", bandwidth: float = 4.0) -> dict:
    k, n, t = regressors.shape
    y, x = _within(outcome), np.array([_within(r) for r in regressors])
    flat = x.reshape(k, -1).T
    b, u, inv = ols(y.ravel(), flat)
    se = np.sqrt(np.diag(panel_cov(x, u.reshape(n, t), inv, se_type, bandwidth)))
    return {"params": b, "bse": se, "tvalues": b / se, "se_type": se_type}


def panel_lp(outcome: np.ndarray, shock: np.ndarray, horizon: int = 8, n_lag_controls: int = 2, se_type: str = "driscoll_kraay", bandwidth: float = 4.0, cumulative: bool = False, jackknife: bool = False) -> dict:
    n, total = outcome.shape
    p = n_lag_controls

    def estimate(y, s):
        irf, se, nobs = [], [], []
        sums = np.concatenate([np.zeros((n, 1)), np.cumsum(y, axis=1)], axis=1)
        for h in range(horizon + 1):
            t = np.arange(p, y.shape[1] - h)
            target = sums[:, t + h + 1] - sums[:, t] if cumulative else y[:, t + h]
            x = np.array([np.broadcast_to(s[t], target.shape)] + [y[:, t - j] for j in range(1, p + 1)] + [np.broadcast_to(s[t - j], target.shape) for j in range(1, p + 1)])
            f = panel_fe(target, x, se_type, bandwidth)
            irf.append(f["params"][0])
            se.append(f["bse"][0])
            nobs.append(target.size)
        return np.array(irf), np.array(se), nobs

    irf, se, nobs = estimate(outcome, shock)
    if jackknife:
        half = total // 2
        a, b = estimate(outcome[:, :half], shock[:half])[0], estimate(outcome[:, half:], shock[half:])[0]
        irf = 2 * irf - (a + b) / 2
    return {"irf": irf, "se": se, "nobs": nobs, "se_type": se_type, "cumulative": float(cumulative), "jackknife": float(jackknife)}


def lp_did(outcome: np.ndarray, treatment: np.ndarray, pre_window: int = 4, post_window: int = 8) -> dict:
    """y_{t+h} - y_{t-1} on entry into an absorbing treatment with period effects, against units not yet treated at t + h."""
    n, total = outcome.shape
    d = np.zeros_like(treatment)
    d[:, 1:] = treatment[:, 1:] - treatment[:, :-1]
    hs, coef, se, nobs, switch = list(range(-pre_window, post_window + 1)), [], [], [], []
    for h in hs:
        if h == -1:
            coef.append(0.0)
            se.append(0.0)
            nobs.append(0)
            switch.append(0)
            continue
        rows = []
        for i in range(n):
            for t in range(1, total):
                if not 0 <= t + h < total:
                    continue
                entering = d[i, t] == 1
                clean = treatment[i, max(t, t + h)] == 0 and treatment[i, t] == 0
                if entering or clean:
                    rows.append((i, t, outcome[i, t + h] - outcome[i, t - 1], float(entering)))
        a = np.array(rows)
        y, x = a[:, 2].copy(), a[:, 3].copy()
        for t in np.unique(a[:, 1]):
            at = a[:, 1] == t
            y[at] -= y[at].mean()
            x[at] -= x[at].mean()
        sxx = x @ x
        if sxx <= 0:
            coef.append(np.nan)
            se.append(np.nan)
        else:
            b = x @ y / sxx
            u = y - b * x
            g = np.array([(x * u)[a[:, 0] == i].sum() for i in np.unique(a[:, 0])])
            k = 1 + len(np.unique(a[:, 1]))
            c = len(g) / (len(g) - 1) * (len(y) - 1) / max(1, len(y) - k)
            coef.append(b)
            se.append(math.sqrt(c * (g @ g)) / sxx)
        nobs.append(len(a))
        switch.append(int(a[:, 3].sum()))
    return {"horizons": hs, "coef": coef, "se": se, "nobs": nobs, "n_switchers": switch}


def mean_group(y: list, x: list, method: str = "mg") -> dict:
    """Unit-by-unit slopes and their average; cce adds period averages."""
    if method == "cce":
        ybar, xbar = np.mean(y, axis=0), np.mean(x, axis=0)
    slopes = []
    for a, b in zip(y, x, strict=True):
        z = np.column_stack([b, np.ones(len(a))] + ([ybar, xbar] if method == "cce" else []))
        slopes.append(np.linalg.lstsq(z, a, rcond=None)[0][: b.shape[1]])
    s = np.array(slopes)
    se = s.std(axis=0, ddof=1) / math.sqrt(len(s))
    return {"coef": s.mean(axis=0), "se": se, "tstat": s.mean(axis=0) / se, "coef_per_unit": s, "n_units": len(s), "k": s.shape[1]}


def panel_pmg(y: list, x: list, max_iter: int = 200, tol: float = 1e-10) -> dict:
    """Pooled long-run coefficient of ARDL(1, 1) error corrections, by the concentrated likelihood."""
    k = x[0].shape[1]
    parts = []
    for a, b in zip(y, x, strict=True):
        z = np.column_stack([np.ones(len(a) - 1), np.diff(b, axis=0)])
        project = lambda v, z=z: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        parts.append((project(np.diff(a)), project(a[:-1]), project(b[1:]), len(a) - 1))
    theta = mean_group([a[1:] for a in y], [b[1:] for b in x])["coef"]
    it = 0
    for it in range(1, max_iter + 1):
        lhs, rhs = np.zeros((k, k)), np.zeros(k)
        for dy, y1, xs, n in parts:
            e = y1 - xs @ theta
            phi = e @ dy / (e @ e)
            s2 = ((dy - phi * e) ** 2).sum() / n
            lhs += phi**2 / s2 * xs.T @ xs
            rhs += phi / s2 * xs.T @ (phi * y1 - dy)
        new = np.linalg.solve(lhs, rhs)
        moved = np.abs(new - theta).max()
        theta = new
        if moved < tol:
            break
    phis, s2s, ll = [], [], 0.0
    for dy, y1, xs, n in parts:
        e = y1 - xs @ theta
        phi = e @ dy / (e @ e)
        s2 = ((dy - phi * e) ** 2).sum() / n
        phis.append(phi)
        s2s.append(s2)
        ll += -n / 2 * (math.log(2 * math.pi * s2) + 1)
    return {"theta": theta, "theta_se": np.sqrt(np.diag(np.linalg.inv(lhs))), "phi_bar": np.mean(phis), "phi": phis, "sigma2": s2s, "loglik": ll, "iterations": it, "n_units": len(parts), "k": k}


def panel_unit_root(series: list, test: str = "fisher", lags: int | None = None, regression: str = "c", max_lags: int | None = None) -> dict:
    """Fisher's P and Choi's Z over units; the t-bar of IPS is reported with its simulated-moment standardisation for long panels."""
    from .diagnostics import adf

    fits = [adf(s, regression, None if lags is not None else "aic", lags if lags is not None else max_lags) for s in series]
    p = np.array([max(f["p_value"], 1e-300) for f in fits])
    t = np.array([f["statistic"] for f in fits])
    n = len(p)
    mw = -2 * np.log(p).sum()
    z = sum(S.norm_ppf(min(max(v, 1e-15), 1 - 1e-15)) for v in p) / math.sqrt(n)
    # Limit mean and variance of the Dickey-Fuller t statistic.
    mean, var = {"c": (-1.533, 0.706), "ct": (-2.166, 0.545)}[regression]
    w = math.sqrt(n) * (t.mean() - mean) / math.sqrt(var)
    stat, pv = {"fisher": (mw, S.chi2_sf(mw, 2 * n)), "choi": (z, S.norm_cdf(z)), "ips": (w, S.norm_cdf(w))}[test]
    return {"test": test, "statistic": stat, "p_value": pv, "per_unit_tstat": t, "per_unit_pvalue": p, "per_unit_lags": [f["used_lag"] for f in fits], "per_unit_nobs": [f["nobs"] for f in fits], "n_units": n, "regression": regression, "t_bar": t.mean(), "maddala_wu": mw, "choi_z": z, "ips_w": w}


def mean_group_var(entities: list, lags: int = 1, trend: str = "c", horizon: int = 10, response: int = 0, impulse: int = 0) -> dict:
    from .varmodels import Var

    fits = [Var(e, lags, trend) for e in entities]
    irfs = np.array([f.irf(horizon) for f in fits])
    coefs = np.array([f.b for f in fits])
    root = math.sqrt(len(fits))
    return {"coefs": coefs.mean(axis=0), "coefs_se": coefs.std(axis=0, ddof=1) / root, "orth_irfs": irfs.mean(axis=0), "orth_irfs_se": irfs.std(axis=0, ddof=1) / root, "irf_path": irfs.mean(axis=0)[:, response, impulse], "irf_path_se": irfs.std(axis=0, ddof=1)[:, response, impulse] / root, "n_entities": len(fits), "neqs": fits[0].k, "lags": lags}


