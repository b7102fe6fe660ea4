"""Operators that repeat a computation over seeds: bootstraps, posterior draws and set identification.

One series of a model (a T x k table) is read in order and travels with the task; replications are rows of ``spark.range``, dealt over the
cluster, each with its own child of the seed's sequence, and summaries over them are aggregates. Results do not depend on how rows are dealt.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diagnostics as D
from ..functions import filters as L
from ..functions import forecasting as C
from ..functions import special as S
from ..functions import spectest as R
from ..functions import varmodels as V
from ..plans.kernel import grouped, replicate, result_frame

PROBS = (0.05, 0.16, 0.5, 0.84, 0.95)


def matrix(df: DataFrame, columns: Sequence[str], time: str) -> np.ndarray:
    """One model's series, in order."""
    return df.select(time, *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns))).orderBy(time).toPandas().iloc[:, 1:].to_numpy(float)


def summary(draws: DataFrame, field: str, probs: Sequence[float] = PROBS) -> DataFrame:
    """(i, j, k, mean, lower, upper, quantiles) of a field over replications, cell by cell."""
    q = F.percentile("value", F.array(*(F.lit(p) for p in probs)))
    return draws.where(F.col("field") == field).groupBy("i", "j", "k").agg(F.avg("value").alias("mean"), F.min("value").alias("set_min"), F.max("value").alias("set_max"), q.alias("quantiles"), F.count("value").alias("n"))


def philox_uniforms(spark, seed: int = 0, n: int = 100) -> DataFrame:
    """(i, value): the generator's uniforms; a task skips ahead to its own."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for i in frame["id"]:
                bits = np.random.Philox(np.random.SeedSequence(seed))
                bits.advance(int(i) // 4)
                own = np.random.Generator(bits)
                own.random(int(i) % 4)
                out.append(own.random())
            yield pd.DataFrame({"i": frame["id"], "value": out})

    return spark.range(n).mapInPandas(run, "i long, value double")


def bootstrap_indices(spark, n: int, scheme: str = "stationary", seed: int = 0, block_length: int | None = None, p: float | None = None, replications: int = 1) -> DataFrame:
    """(rep, field, i, …, value): row numbers of each resample."""
    if replications == 1:
        return result_frame(spark, {"index": C.bootstrap_indices(n, scheme, seed, block_length, p)}).select(F.lit(0).cast("long").alias("rep"), "*")
    return replicate(spark, replications, seed, lambda rng, i: {"index": C.bootstrap_indices(n, scheme, block_length=block_length, p=p, bits=rng.bit_generator)})


def setar_test(df: DataFrame, y: str, time: str, p: int = 1, delay: int = 1, trim: float = 0.15, n_boot: int = 499, seed: int = 0) -> DataFrame:
    """Linearity against a threshold, with a fixed-regressor wild bootstrap."""
    spark = df.sparkSession
    data = matrix(df, [y], time)[:, 0]
    top = max(p, delay)
    target, x = R._setar_design(data, p, top, True)
    z = data[top - delay : len(data) - delay]
    stat = R.setar_stat(target, x, z, trim)
    u = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
    draws = replicate(spark, n_boot, seed, lambda rng, i: {"stat": R.setar_stat(u * rng.standard_normal(len(u)), x, z, trim)})
    return draws.agg(F.lit(stat).alias("stat"), ((F.count_if(F.col("value") >= stat) + 1) / (n_boot + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_boot"), F.lit(len(target)).alias("nobs"))


def var_irf_bands(df: DataFrame, columns: Sequence[str], time: str, lags: int = 2, horizon: int = 10, orth: bool = True, alpha: float = 0.1, n_boot: int = 1000, seed: int = 0, cumulative: bool = False) -> DataFrame:
    """(i, j, k, point, se, lower, upper): residual bootstrap of impulse responses; i horizon, j response, k shock."""
    data = matrix(df, columns, time)
    v = V.Var(data, lags)

    def responses(model):
        r = model.irf(horizon) if orth else model.psi(horizon)
        return np.cumsum(r, axis=0) if cumulative else r

    centred = v.u - v.u.mean(axis=0)

    def body(rng, _):
        e = centred[rng.integers(0, len(centred), len(centred))]
        sim = np.vstack([data[:lags], np.zeros_like(e)])
        for t in range(len(e)):
            sim[lags + t] = v.b[0] + sum(v.a[j] @ sim[lags + t - 1 - j] for j in range(lags)) + e[t]
        try:
            return {"irf": responses(V.Var(sim, lags))}
        except ValueError:  # an explosive path cannot be fitted; it counts as failed
            return {"failed": 1.0}

    draws = replicate(df.sparkSession, n_boot, seed, body)
    bands = draws.where("field = 'irf'").groupBy("i", "j", "k").agg(F.stddev_samp("value").alias("se"), F.percentile("value", F.lit(alpha / 2)).alias("lower"), F.percentile("value", F.lit(1 - alpha / 2)).alias("upper"))
    point = result_frame(df.sparkSession, {"irf": responses(v)}).select("i", "j", "k", F.col("value").alias("point"))
    return point.join(bands, ["i", "j", "k"])


def _accepted(irf: np.ndarray, restrictions: Sequence[tuple]) -> bool:
    return all(irf[h, var, shock] * sign > 0 for var, shock, h, sign in restrictions)


def _zero_rotation(rng: np.random.Generator, theta: np.ndarray, zeros: Sequence[tuple]) -> np.ndarray:
    """An orthogonal matrix whose column j solves the zero restrictions of shock j: columns with more zeros first, each drawn in what is left."""
    k = theta.shape[1]
    rows = {j: [theta[h, var] for var, shock, h in zeros if shock == j] for j in range(k)}
    q = np.zeros((k, k))
    done: list[np.ndarray] = []
    for j in sorted(range(k), key=lambda j: -len(rows[j])):
        limits = np.array(rows[j] + done)
        x = rng.standard_normal(k)
        if len(limits):
            _, s, vt = np.linalg.svd(limits)
            basis = vt[int((s > 1e-12).sum()) :].T
            if basis.shape[1] == 0:
                raise ValueError("too many zero restrictions on one shock")
            x = basis @ (basis.T @ x)
        q[:, j] = x / np.linalg.norm(x)
        done.append(q[:, j])
    return q


def identified_draws(df: DataFrame, columns: Sequence[str], time: str, restrictions: Sequence[tuple] = (), zeros: Sequence[tuple] = (), narrative: Sequence[tuple] = (), lags: int = 2, horizon: int = 12, n_draws: int = 500, max_tries: int = 400, seed: int = 0, lambda1: float = 0.2, n_weight_draws: int = 200) -> DataFrame:
    """Replications with the accepted impulse responses (field irf: i horizon, j response, k shock), tries, and the weight of narrative restrictions.

    Restrictions are (variable, shock, horizon, sign); zeros (variable, shock, horizon); narrative (shock, row after the lags, sign)."""
    niw = V.Niw(matrix(df, columns, time), lags, lambda1=lambda1)
    k = niw.v.k

    def body(rng, _):
        b, sigma = niw.draw(rng)
        chol = np.linalg.cholesky(sigma)
        base = niw.responses(b, chol, horizon)
        u = niw.v.y - niw.v.z @ b
        white = np.linalg.solve(chol, u.T).T
        for tries in range(1, max_tries + 1):
            q = _zero_rotation(rng, base, zeros) if zeros else V.haar(rng, k)
            irf = base @ q
            for j in range(k):  # a shock's own sign is free until a restriction fixes it
                own = [r for r in restrictions if r[1] == j]
                if own and irf[own[0][2], own[0][0], j] * own[0][3] < 0:
                    q[:, j], irf[:, :, j] = -q[:, j], -irf[:, :, j]
            e = white @ q
            if _accepted(irf, restrictions) and all(e[t, s] * sign > 0 for s, t, sign in narrative):
                weight = 1.0
                if narrative:
                    sim = rng.standard_normal((n_weight_draws, len(narrative)))
                    weight = 1 / max((sim > 0).all(axis=1).mean(), 1 / n_weight_draws)
                return {"irf": irf, "tries": tries, "accepted": 1.0, "weight": weight}
        return {"tries": max_tries, "accepted": 0.0}

    return replicate(df.sparkSession, n_draws, seed, body)


def sign_restricted_svar(df: DataFrame, columns: Sequence[str], time: str, restrictions: Sequence[tuple], **options) -> DataFrame:
    return summary(identified_draws(df, columns, time, restrictions, **options), "irf")


def zero_sign_svar(df: DataFrame, columns: Sequence[str], time: str, restrictions: Sequence[tuple], zeros: Sequence[tuple], **options) -> DataFrame:
    return summary(identified_draws(df, columns, time, restrictions, zeros, **options), "irf")


def narrative_svar(df: DataFrame, columns: Sequence[str], time: str, restrictions: Sequence[tuple], narrative: Sequence[tuple], **options) -> DataFrame:
    return summary(identified_draws(df, columns, time, restrictions, narrative=narrative, **options), "irf")


def fry_pagan_svar(df: DataFrame, columns: Sequence[str], time: str, restrictions: Sequence[tuple], **options) -> DataFrame:
    """(rep, i, j, k, value, median): the accepted draw that is closest to the medians in standard deviations."""
    draws = identified_draws(df, columns, time, restrictions, **options).where("field = 'irf'").select("rep", "i", "j", "k", "value")
    cell = draws.groupBy("i", "j", "k").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_pop("value").alias("sd"))
    shocks = {s for _, s, _, _ in restrictions}
    apart = draws.join(cell, ["i", "j", "k"])
    far = apart.where(F.col("k").isin(*shocks)).groupBy("rep").agg(F.sum(F.pow((F.col("value") - F.col("median")) / F.nullif("sd", F.lit(0.0)), 2)).alias("d"))
    best = far.agg(F.min_by("rep", F.struct("d", "rep")).alias("rep"))
    return apart.join(F.broadcast(best), "rep").select("rep", "i", "j", "k", "value", "median")


def _directions(g: np.ndarray, normals: np.ndarray):
    """Unit vectors that may be extremes of g'q where normals q >= 0: of g in the complement of each set of active normals."""
    n = len(g)
    for size in range(min(len(normals), n - 1) + 1):
        for active in itertools.combinations(range(len(normals)), size):
            own = normals[list(active)]
            q = g - np.linalg.pinv(own) @ (own @ g) if size else g
            length = np.linalg.norm(q)
            if length > 1e-10 * max(np.linalg.norm(g), 1e-300):
                yield q / length
                yield -q / length


def _nonempty(normals: np.ndarray) -> bool:
    """Is there a unit vector q with normals q >= 0?"""
    n = normals.shape[1]
    if n == 0:
        return False
    probe = np.random.Generator(np.random.Philox(n)).standard_normal(n)
    return any((normals @ q >= -1e-9).all() for q in _directions(probe, normals))


def sphere_bounds(g: np.ndarray, normals: np.ndarray) -> tuple[float, float] | None:
    """The least and greatest g'q over unit vectors q with normals q >= 0, in closed form; none where there is no such q."""
    normals = normals / np.linalg.norm(normals, axis=1, keepdims=True)
    length = np.linalg.norm(g)
    if length <= 1e-12:
        return (0.0, 0.0) if _nonempty(normals) else None
    values = [float(g @ q) for q in _directions(g, normals) if (normals @ q >= -1e-9).all()]
    # A face where g'q is 0 throughout has no direction of its own.
    if _nonempty(normals @ np.linalg.svd(g[None, :])[2][1:].T):
        values.append(0.0)
    return (min(values), max(values)) if values else None


def robust_svar_bounds(df: DataFrame, columns: Sequence[str], time: str, restrictions: Sequence[tuple], lags: int = 2, horizon: int = 12, n_draws: int = 500, seed: int = 0, lambda1: float = 0.2, alpha: float = 0.10) -> DataFrame:
    """(i, j, k, set_lower_mean, set_upper_mean, robust_ci_lower, robust_ci_upper): exact bounds of the identified set of each posterior draw, for each restricted shock.

    Where several shocks are restricted, each has the bounds of its own restrictions: they contain those of the joint set."""
    niw = V.Niw(matrix(df, columns, time), lags, lambda1=lambda1)
    shocks = sorted({s for _, s, _, _ in restrictions})

    def body(rng, _):
        b, sigma = niw.draw(rng)
        base = niw.responses(b, np.linalg.cholesky(sigma), horizon)
        low, high = (np.full(base.shape, np.nan) for _ in range(2))
        for shock in shocks:
            normals = np.array([sign * base[h, var] for var, s, h, sign in restrictions if s == shock])
            for h, i in np.ndindex(base.shape[:2]):
                bounds = sphere_bounds(base[h, i], normals)
                if bounds is None:
                    return {"nonempty": 0.0}
                low[h, i, shock], high[h, i, shock] = bounds
        return {"nonempty": 1.0, "low": low, "high": high}

    draws = replicate(df.sparkSession, n_draws, seed, body)
    at = lambda f: F.when(F.col("field") == f, F.col("value"))
    return draws.where("field IN ('low', 'high')").where(F.col("k").isin(shocks)).groupBy("i", "j", "k").agg(
        F.avg(at("low")).alias("set_lower_mean"), F.avg(at("high")).alias("set_upper_mean"), F.percentile(at("low"), F.lit(alpha / 2)).alias("robust_ci_lower"), F.percentile(at("high"), F.lit(1 - alpha / 2)).alias("robust_ci_upper")
    )


def proxy_svar_bands(df: DataFrame, columns: Sequence[str], proxy: str, time: str, lags: int = 2, horizon: int = 12, norm_var: int = 0, unit: float = 1.0, alpha: float = 0.10, n_boot: int = 2000, seed: int = 0, block_length: int | None = None) -> DataFrame:
    """(i, j, point, lower, upper, se): moving blocks of residuals and proxy together; the VAR is estimated anew in each replication."""
    data = matrix(df, [*columns, proxy], time)
    y, m = data[:, :-1], data[:, -1]
    v = V.Var(y, lags)
    size = block_length or max(2, round(5.03 * v.t**0.25))
    blocks = v.t - size + 1
    offset = np.array([v.u[s : s + blocks].mean(axis=0) for s in range(size)])

    def body(rng, _):
        starts = rng.integers(0, blocks, -(-v.t // size))
        at = np.concatenate([np.arange(s, s + size) for s in starts])[: v.t]
        e = v.u[at] - offset[np.arange(v.t) % size]
        sim = np.vstack([y[:lags], np.zeros_like(e)])
        for t in range(v.t):
            sim[lags + t] = v.b[0] + sum(v.a[j] @ sim[lags + t - 1 - j] for j in range(lags)) + e[t]
        try:
            return {"irf": V.proxy_svar(sim, np.concatenate([m[:lags], m[lags:][at]]), lags, horizon, norm_var, unit)["irf"]}
        except ValueError:
            return {"failed": 1.0}

    draws = replicate(df.sparkSession, n_boot, seed, body)
    bands = draws.where("field = 'irf'").groupBy("i", "j").agg(F.percentile("value", F.lit(alpha / 2)).alias("lower"), F.percentile("value", F.lit(1 - alpha / 2)).alias("upper"), F.stddev_samp("value").alias("se"))
    point = result_frame(df.sparkSession, {"irf": V.proxy_svar(y, m, lags, horizon, norm_var, unit)["irf"]}).select("i", "j", F.col("value").alias("point"))
    return point.join(bands, ["i", "j"])


def proxy_ar_sets(df: DataFrame, columns: Sequence[str], proxy: str, time: str, lags: int = 2, horizon: int = 12, norm_var: int = 0, unit: float = 1.0, alpha: float = 0.05) -> DataFrame:
    """(i, j, kind, lower, upper, point): Anderson-Rubin sets of normalised responses that hold for weak proxies too, at the estimated reduced form.

    A response is a ratio a / b of jointly normal covariances; the set of ratios that are not rejected solves a quadratic inequality."""
    data = matrix(df, [*columns, proxy], time)
    y, m = data[:, :-1], data[lags:, -1]
    v = V.Var(y, lags)
    ok = ~np.isnan(m)
    u, z = v.u[ok], m[ok] - m[ok].mean()
    s = u * z[:, None]
    gamma = s.mean(axis=0)
    omega = (s - gamma).T @ (s - gamma) / len(s)
    n, crit = len(s), S.norm_ppf(1 - alpha / 2) ** 2
    psi = v.psi(horizon)
    rows = []
    for h in range(horizon + 1):
        for i in range(v.k):
            a, b = psi[h, i] @ gamma * unit, gamma[norm_var]
            vaa, vab, vbb = psi[h, i] @ omega @ psi[h, i] * unit**2, psi[h, i] @ omega[:, norm_var] * unit, omega[norm_var, norm_var]
            q2, q1, q0 = n * b * b - crit * vbb, -2 * (n * a * b - crit * vab), n * a * a - crit * vaa
            disc = q1 * q1 - 4 * q2 * q0
            if i == norm_var and h == 0:
                kind, low, high = "point", unit, unit
            elif disc < 0:
                kind, low, high = ("empty" if q2 > 0 else "whole"), None, None
            else:
                r = sorted([(-q1 - math.sqrt(disc)) / (2 * q2), (-q1 + math.sqrt(disc)) / (2 * q2)])
                kind, low, high = ("interval" if q2 > 0 else "exterior"), r[0], r[1]
            rows.append((h, i, kind, None if low is None else float(low), None if high is None else float(high), float(a / b)))
    return df.sparkSession.createDataFrame(rows, "i int, j int, kind string, lower double, upper double, point double")


def bvar_irf_draws(df: DataFrame, columns: Sequence[str], time: str, lags: int = 2, horizon: int = 16, n_draws: int = 500, seed: int = 0, cumulative: bool = False, **prior) -> DataFrame:
    """(rep, field, i, j, k, value, note): Cholesky impulse responses of posterior draws."""
    niw = V.Niw(matrix(df, columns, time), lags, **prior)

    def body(rng, _):
        b, sigma = niw.draw(rng)
        r = niw.responses(b, np.linalg.cholesky(sigma), horizon)
        return {"irf": np.cumsum(r, axis=0) if cumulative else r}

    return replicate(df.sparkSession, n_draws, seed, body)


def ssvs_coefficients(r: np.ndarray, rb: np.ndarray, p: np.ndarray, d: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """A draw of the coefficients (m x k) given the errors' precision p p' and the prior variances d (m x k); r'r is Z'Z and rb = r b of least squares.

    In units of the prior's deviations the posterior's precision is a product of a matrix with itself plus the identity. That matrix over the identity is
    factored, not the product, so series of any units, and nearly collinear ones, keep their digits.
    """
    m, k = d.shape
    s = np.sqrt(d.T.ravel())
    q, t = np.linalg.qr(np.vstack([np.kron(p.T, r) * s, np.eye(m * k)]))
    sign = np.sign(np.diag(t))
    target = (rb @ p).T.ravel()
    return (s * np.linalg.solve(t * sign[:, None], sign * (q[: m * k].T @ target) + noise)).reshape(k, m).T


def bvar_ssvs(df: DataFrame, columns: Sequence[str], time: str, lags: int = 2, n_draws: int = 1000, burn: int = 200, seed: int = 0, c0: float = 0.1, c1: float = 10.0, prior_inclusion: float = 0.5, n_chains: int = 2) -> DataFrame:
    """(field, i, j, value): inclusion probabilities and coefficient means of stochastic search, one task a chain."""
    v = V.Var(matrix(df, columns, time), lags)
    k, m = v.k, v.m
    se = np.sqrt(np.outer(np.diag(v.inv), np.diag(v.sigma)))
    small, large = (c0 * se) ** 2, (c1 * se) ** 2
    r = np.linalg.qr(v.z, mode="r")
    rb = r @ v.b

    def body(rng, _):
        b, inc = v.b.copy(), np.ones((m, k))
        total_b, total_i, kept = np.zeros((m, k)), np.zeros((m, k)), 0
        for it in range(n_draws + burn):
            u = v.y - v.z @ b
            low = np.linalg.qr(u[:, ::-1], mode="r")[::-1, ::-1]
            w = np.linalg.inv(low * np.sign(np.diag(low))[:, None])  # lower, w w' = inv(u'u)
            a = np.tril(rng.standard_normal((k, k)), -1) + np.diag(np.sqrt(rng.chisquare(v.t - np.arange(k))))
            d = np.where(inc == 1, large, small)
            d[0] = large[0]
            b = ssvs_coefficients(r, rb, w @ a, d, rng.standard_normal(m * k))
            l1 = math.log(prior_inclusion) - 0.5 * np.log(large) - 0.5 * b**2 / large
            l0 = math.log(1 - prior_inclusion) - 0.5 * np.log(small) - 0.5 * b**2 / small
            inc = (rng.random((m, k)) < 1 / (1 + np.exp(np.clip(l0 - l1, -700, 700)))).astype(float)
            if it >= burn:
                total_b += b
                total_i += inc
                kept += 1
        return {"inclusion_prob": total_i / kept, "coef_mean": total_b / kept}

    draws = replicate(df.sparkSession, n_chains, seed, body)
    return draws.groupBy("field", "i", "j").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("between_chains"))


def dfm_news(old: DataFrame, new: DataFrame, columns: Sequence[str], time: str, **options) -> DataFrame:
    """Result rows: what each cell that is new in the later vintage adds to the nowcast."""
    return result_frame(old.sparkSession, C.dfm_news(matrix(old, columns, time), matrix(new, columns, time), **options))


def dsge_solve(spark, a, b, c, n_predetermined: int) -> DataFrame:
    return result_frame(spark, C.dsge_solve(a, b, c, n_predetermined))


def gmm_nonlinear(df: DataFrame, columns: Sequence[str], time: str, moments_fn, initial, weight=None) -> DataFrame:
    """``moments_fn(theta, data)`` gives a row of moments for each row of the ordered matrix."""
    data = matrix(df, columns, time)
    return result_frame(df.sparkSession, C.gmm_nonlinear(lambda t: moments_fn(t, data), initial, weight))


def _check(y: np.ndarray, seasonal_period: int | None = None, lags: int | None = None, alpha: float = 0.05, max_breaks: int = 3, trim: float = 0.15) -> dict:
    if not 0.01 < alpha <= 0.10:
        raise ValueError("alpha must be over 0.01 and at most 0.10")
    n = len(y)
    med = np.median(y)
    mad = np.median(np.abs(y - med))
    out: dict = {
        "n": n, "mean": y.mean(), "std": y.std(ddof=1), "min": y.min(), "max": y.max(),
        "n_outliers": int((np.abs(0.6745 * (y - med) / mad) > 3.5).sum()) if mad > 0 else 0,
    }
    st = D.check_stationarity(y, alpha)
    out["stationarity"] = st
    scale = {"UnitRoot": "first difference", "Conflict": "detrended"}.get(st["quadrant"], "level")
    x = np.diff(y) if scale == "first difference" else y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n)) if scale == "detrended" else y
    d = x - x.mean()
    h = lags or min(10, len(x) // 5)
    r = np.array([d[k:] @ d[: len(d) - k] for k in range(1, h + 1)]) / (d @ d)
    lb = len(d) * (len(d) + 2) * (r**2 / (len(d) - np.arange(1, h + 1))).sum()
    s, k = (d**3).mean() / d.std() ** 3, (d**4).mean() / d.std() ** 4
    jb = len(d) / 6 * (s * s + (k - 3) ** 2 / 4)
    out |= {"analysis_scale": scale, "ljung_box": lb, "ljung_box_p": S.chi2_sf(lb, h), "jarque_bera": jb, "jarque_bera_p": math.exp(-jb / 2), "arch": D.arch_lm(d)}
    advice = [st["recommendation"]]
    if out["ljung_box_p"] < alpha:
        advice.append("model the serial correlation")
    if out["arch"]["p_value"] < alpha:
        advice.append("model the conditional variance")
    if n >= 40:
        b = R.bai_perron(x, np.ones((len(x), 1)), max_breaks, trim)
        out |= {"n_breaks": b["n_breaks"], "break_dates": b["break_dates"] or None, "long_memory": L.long_memory_d(x)}
        if b["n_breaks"]:
            advice.append("allow for breaks")
    if seasonal_period and n >= 2 * seasonal_period:
        out["seasonality"] = L.seasonal_strength(y, seasonal_period)
        if out["seasonality"]["seasonal_strength"] >= 0.64:
            advice.append("difference or model the seasonality")
    return out | {"recommendations": advice}


def check_series(df: DataFrame, y: str, time: str, key: Sequence[str] = (), **options) -> DataFrame:
    """A battery of checks of each key's series, as result rows."""
    return grouped(df, _check, [y], time, key, **options)


def summarize(result: DataFrame, title: str = "Result") -> str:
    """A result's scalars and notes as text, one line each."""
    rows = result.where("i IS NULL").orderBy("field").collect()
    width = max([len(r["field"]) for r in rows], default=0)
    lines = [f"{r['field']:<{width}}  {r['note'] if r['note'] is not None else '-' if r['value'] is None else format(r['value'], '.6g')}" for r in rows]
    return "\n".join([title, "=" * len(title), *lines])
