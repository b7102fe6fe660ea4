"""SQL of registered kernel queries with several equations, spectra, local projections with instruments, and unit roots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from ..functions import tables as T
from ..sources import series as S
from . import sqlkit as Q
from .kernel_sql import MONTHS, PANEL, REGRESSION, RETURNS, lags, vector

K = range(3)
V3 = ["y", "n_", "a"]


def var_base(p: int, names: Sequence[str] = V3, source: str = MONTHS, first: int = 0) -> str:
    """CTEs f (rows) and v (one row a key: coefficients b, covariance s, its Cholesky factor l, n, k)."""
    m = len(names)
    every = ", ".join(f"lag({c}, {j}) OVER (PARTITION BY g ORDER BY t) AS {c}_{j}" for j in range(1, p + 1) for c in names)
    rows = f"SELECT * FROM (SELECT g, t, {', '.join(names)}, row_number() OVER (PARTITION BY g ORDER BY t) AS nth, {every} FROM ({source})) WHERE nth > {max(p, first)}"
    base = Q.least_squares("f", rows, names, ["1.0", *(f"{c}_{j}" for j in range(1, p + 1) for c in names)])
    k = 1 + p * m
    heads = [f"any_value(b{u}_{i}) AS b{u}_{i}" for u in range(m) for i in range(k)] + [f"any_value(v{i}_{q}) AS v{i}_{q}" for i in range(k) for q in range(i, k)]
    cov = [f"sum(e{i} * e{j}) / (any_value(n) - any_value(k)) AS s{i}_{j}" for i in range(m) for j in range(i + 1)]
    return f"{base}, v0 AS (SELECT g, any_value(n) AS n, any_value(k) AS k, {', '.join(heads + cov)} FROM f GROUP BY g), v AS (SELECT *, {', '.join(cholesky('s', 'l', m))} FROM v0)"


def cholesky(s: str, into: str, m: int) -> list[str]:
    out = []
    for i in range(m):
        for j in range(i + 1):
            left = " - ".join([f"{s}{i}_{j}", *(f"{into}{i}_{q} * {into}{j}_{q}" for q in range(j))])
            out.append(f"{f'sqrt({left})' if i == j else f'({left}) / {into}{j}_{j}'} AS {into}{i}_{j}")
    return out


def s_of(i: int, j: int) -> str:
    return f"s{max(i, j)}_{min(i, j)}"


def responses(p: int, horizon: int, m: int = 3) -> str:
    """A CTE w: v with p{h}_{i}_{j}, the moving average coefficients."""
    out = [[f"{float(i == j)} AS p0_{i}_{j}" for i in range(m) for j in range(m)]]
    for h in range(1, horizon + 1):
        out.append([" + ".join(f"b{i}_{1 + l * m + q} * p{h - 1 - l}_{q}_{j}" for l in range(min(p, h)) for q in range(m)) + f" AS p{h}_{i}_{j}" for i in range(m) for j in range(m)])
    return Q.chain("w", "v", out)


def theta(horizon: int, impact: str, into: str = "o", m: int = 3, lower: bool = True) -> str:
    """Columns {into}{h}_{i}_{j}: responses to shocks with that impact."""
    return ", ".join(" + ".join(f"p{h}_{i}_{q} * {impact}{q}_{j}" for q in range(j if lower else 0, m)) + f" AS {into}{h}_{i}_{j}" for h in range(horizon + 1) for i in range(m) for j in range(m))


def shares(horizon: int, into: str = "o", m: int = 3) -> list[list[str]]:
    """Steps of columns c{h}_{i}_{j}: sums of squares up to h."""
    return [[(f"c{h - 1}_{i}_{j} + " if h else "") + f"pow({into}{h}_{i}_{j}, 2) AS c{h}_{i}_{j}" for i in range(m) for j in range(m)] for h in range(horizon + 1)]


def share(h: int, i: int, j: int) -> str:
    return f"c{h}_{i}_{j} / ({' + '.join(f'c{h}_{i}_{q}' for q in K)})"


def cube(name: str, value, shape: tuple[int, ...]) -> list[tuple]:
    import itertools

    return [(name, at, value(*at)) for at in itertools.product(*(range(x) for x in shape))]


def _irf(horizon: int) -> str:
    return f"WITH {var_base(2)}, {responses(2, horizon)}, r AS (SELECT {theta(horizon, 'l')} FROM w) {Q.fields('r', cube('irf', lambda h, i, j: f'o{h}_{i}_{j}', (horizon + 1, 3, 3)))}"


def _fevd(horizon: int, impact: bool) -> str:
    rows = cube("fevd", lambda i, h, j: share(h, i, j), (3, horizon, 3))
    if impact:
        rows += cube("impact", lambda i, j: f"l{i}_{j}" if j <= i else "0.0", (3, 3))
    return f"WITH {var_base(2)}, {responses(2, horizon - 1)}, o AS (SELECT *, {theta(horizon - 1, 'l')} FROM w), {Q.chain('r', 'o', shares(horizon - 1))} {Q.fields('r', rows)}"


def _forecast(steps: int) -> str:
    last = [f"(SELECT {c} FROM ({MONTHS}) ORDER BY t DESC LIMIT 1 OFFSET {j}) AS m{1 + j}_{i}" for j in range(2) for i, c in enumerate(V3)]
    at = lambda h, i: f"y{h}_{i}" if h >= 0 else f"m{-h}_{i}"
    each = []
    for h in range(steps):
        each.append([f"b{i}_0 + " + " + ".join(f"b{i}_{1 + l * 3 + q} * {at(h - 1 - l, q)}" for l in range(2) for q in K) + f" AS y{h}_{i}" for i in K])
        each[-1] += [(f"w{h - 1}_{i} + " if h else "") + " + ".join(f"p{h}_{i}_{q} * {s_of(q, z)} * p{h}_{i}_{z}" for q in K for z in K) + f" AS w{h}_{i}" for i in K]
    z = 1.959963984540054
    rows = []
    for name, value in (("point", "y{h}_{i}"), ("lower", "y{h}_{i} - {z} * sqrt(w{h}_{i})"), ("upper", "y{h}_{i} + {z} * sqrt(w{h}_{i})"), ("se", "sqrt(w{h}_{i})")):
        rows += cube(name, lambda h, i, value=value: value.format(h=h, i=i, z=z), (steps, 3))
    return f"WITH {var_base(2)}, {responses(2, steps - 1)}, q AS (SELECT *, {', '.join(last)} FROM w), {Q.chain('r', 'q', each)} {Q.fields('r', rows)}"


def _granger() -> str:
    """Whether the second variable's lags enter the first equation."""
    det = "(v2_2 * v5_5 - v2_5 * v2_5)"
    stat = f"((b0_2 * b0_2 * v5_5 - 2 * b0_2 * b0_5 * v2_5 + b0_5 * b0_5 * v2_2) / {det} / s0_0 / 2)"
    rows = [("statistic", (), stat), ("p_value", (), Q.f_sf(stat, "2", "(3 * (n - k))")), ("df_num", (), "2"), ("df_den", (), "3 * (n - k)")]
    return f"WITH {var_base(2)} {Q.fields('v', rows)}"


def _order(top: int) -> str:
    parts, names = [], ("aic", "bic", "hqic", "fpe")
    for p in range(1, top + 1):
        text = var_base(p, first=top)
        for c in ("f", "v", "v0"):
            text = text.replace(f" {c} AS ", f" {c}p{p} AS ").replace(f"FROM {c} ", f"FROM {c}p{p} ").replace(f"FROM {c})", f"FROM {c}p{p})")
        parts.append(text.replace("f_", f"fp{p}_"))
        f = f"(3.0 * {1 + 3 * p})"
        parts.append(f"x{p} AS (SELECT n, k, 2 * ln(l0_0 * l1_1 * l2_2) + 3 * ln((n - k) / CAST(n AS DOUBLE)) AS ld FROM vp{p}), c{p} AS (SELECT ld + 2 * {f} / n AS aic, ld + ln(n) * {f} / n AS bic, ld + 2 * ln(ln(n)) * {f} / n AS hqic, pow((n + k) / CAST(n - k AS DOUBLE), 3) * exp(ld) AS fpe FROM x{p})")
    one = "r AS (SELECT " + ", ".join(f"c{p}.{c} AS {c}{p}" for p in range(1, top + 1) for c in names) + " FROM " + ", ".join(f"c{p}" for p in range(1, top + 1)) + ")"
    rows = [row for c in names for row in vector(c, [f"{c}{p}" for p in range(1, top + 1)])]
    for c in names:
        least = f"least({', '.join(f'{c}{p}' for p in range(1, top + 1))})"
        rows.append((f"best_{c}", (), "CASE " + " ".join(f"WHEN {c}{p} = {least} THEN {p}" for p in range(1, top + 1)) + " END"))
    return f"WITH {', '.join(parts)}, {one} {Q.fields('r', rows)}"


def connected(horizon: int) -> str:
    """CTEs ending in r: g{i}_{j}, the normalised generalised decomposition in percent."""
    num = [f"({' + '.join('pow(' + ' + '.join(f'p{h}_{i}_{q} * {s_of(q, j)}' for q in K) + ', 2)' for h in range(horizon))}) / {s_of(j, j)} AS x{i}_{j}" for i in K for j in K]
    scaled = [f"100 * x{i}_{j} / ({' + '.join(f'x{i}_{q}' for q in K)}) AS g{i}_{j}" for i in K for j in K]
    return f"{responses(2, horizon - 1)}, x AS (SELECT *, {', '.join(num)} FROM w), r AS (SELECT *, {', '.join(scaled)} FROM x)"


TO = [" + ".join(f"g{i}_{j}" for i in K if i != j) for j in K]
FROM = [" + ".join(f"g{i}_{j}" for j in K if i != j) for i in K]


def _connectedness(horizon: int) -> str:
    rows = [("total", (), f"({' + '.join(FROM)}) / 3"), *vector("to_others", TO), *vector("from_others", FROM), *vector("net", [f"({TO[i]}) - ({FROM[i]})" for i in K])]
    rows += cube("gfevd", lambda i, j: f"g{i}_{j}", (3, 3)) + cube("pairwise_net", lambda i, j: f"g{j}_{i} - g{i}_{j}" if i != j else "0.0", (3, 3))
    return f"WITH {var_base(2)}, {connected(horizon)} {Q.fields('r', rows)}"


def _rolling(window: int, horizon: int) -> str:
    source = f"SELECT o.i AS g, s.t, y, n_, a FROM (SELECT *, row_number() OVER (ORDER BY t) - 1 AS place FROM ({MONTHS})) s JOIN (SELECT unnest(range(0, (SELECT count(*) FROM ({MONTHS})) - {window} + 1)) AS i) o ON s.place BETWEEN o.i AND o.i + {window} - 1"
    return f"WITH {var_base(2, source=source)}, {connected(horizon)} {Q.fields('r', [('total', ('g',), f'({" + ".join(FROM)}) / 3')])}"


def inverse(a: str, into: str) -> list[str]:
    """A 3 by 3 inverse by cofactors."""
    x = lambda i, j: f"{a}{i % 3}_{j % 3}"
    det = " + ".join(f"{x(0, j)} * ({x(1, j + 1)} * {x(2, j + 2)} - {x(1, j + 2)} * {x(2, j + 1)})" for j in K)
    return [f"{det} AS {into}det", *(f"({x(j + 1, i + 1)} * {x(j + 2, i + 2)} - {x(j + 1, i + 2)} * {x(j + 2, i + 1)}) / {into}det AS {into}{i}_{j}" for i in K for j in K)]


def _long_run(horizon: int) -> str:
    m = [f"{float(i == j)} - b{i}_{1 + j} - b{i}_{4 + j} AS m{i}_{j}" for i in K for j in K]
    omega = [" + ".join(f"k{i}_{q} * {s_of(q, z)} * k{j}_{z}" for q in K for z in K) + f" AS z{i}_{j}" for i in K for j in range(i + 1)]
    low = cholesky("z", "f", 3)
    impact = [" + ".join(f"m{i}_{q} * f{q}_{j}" for q in range(j, 3)) + f" AS i{i}_{j}" for i in K for j in K]
    sums = [own + [(f"u{h - 1}_{i}_{j} + " if h else "") + f"o{h}_{i}_{j} AS u{h}_{i}_{j}" for i in K for j in K] for h, own in enumerate(shares(horizon))]
    steps = f"a1 AS (SELECT *, {', '.join(m)} FROM w), a2 AS (SELECT *, {', '.join(inverse('m', 'k'))} FROM a1), a3 AS (SELECT *, {', '.join(omega)} FROM a2), a4 AS (SELECT *, {', '.join(low)} FROM a3), a5 AS (SELECT *, {', '.join(impact)} FROM a4), a6 AS (SELECT *, {theta(horizon, 'i', lower=False)} FROM a5), {Q.chain('r', 'a6', sums)}"
    rows = cube("impact", lambda i, j: f"i{i}_{j}", (3, 3)) + cube("long_run", lambda i, j: f"f{i}_{j}" if j <= i else "0.0", (3, 3)) + cube("long_run_multiplier", lambda i, j: f"k{i}_{j}", (3, 3))
    shape = (horizon + 1, 3, 3)
    rows += cube("irf", lambda h, i, j: f"o{h}_{i}_{j}", shape) + cube("cumulative_irf", lambda h, i, j: f"u{h}_{i}_{j}", shape) + cube("fevd", share, shape)
    return f"WITH {var_base(2)}, {responses(2, horizon)}, {steps} {Q.fields('r', rows)}"


def _instrumented(h: int, p: int, cumulate: bool) -> tuple[str, str]:
    """CTEs of one horizon: target, impulse and instrument without the controls, then the ratio and its errors."""
    target = f"sum({{}}) OVER (ORDER BY t ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)" if cumulate else f"lead({{}}, {h}) OVER (ORDER BY t)"
    impulse = target.format("n_") if cumulate else "n_"
    controls = [f"y_{j}" for j in range(1, p + 1)] + ([f"n__{j}" for j in range(1, p + 1)] if cumulate else [])
    source = f"SELECT * FROM (SELECT g, t, {target.format('y')} AS yy, {impulse} AS xx, z, lead(y, {h}) OVER (ORDER BY t) AS there, {lags('y', p)}{', ' + lags('n_', p) if cumulate else ''} FROM ({MONTHS})) WHERE there IS NOT NULL AND y_{p} IS NOT NULL"
    f, r = f"f{h}", f"r{h}"
    base = Q.least_squares(f, source, ["yy", "xx", "z"], ["1.0", *controls])
    one = f"{r}_b AS (SELECT any_value(n) AS n, any_value(k) + 1 AS k, sum(e2 * e0) / sum(e2 * e1) AS b, sum(e2 * e1) AS zx, sum(e2 * e1) / sum(e2 * e2) AS c, sum(e2 * e2) AS zz FROM {f})"
    scores = f"{r}_s AS (SELECT rn, e2 * (e0 - b * e1) / zx AS u, e2 * (e1 - c * e2) / zz AS q FROM {f}, {r}_b)"
    weight = f"CASE WHEN x.rn = o.rn THEN 1.0 ELSE 2 * (1 - (x.rn - o.rn) / {h + p + 1}.0) END"
    both = f"{r} AS (SELECT any_value(n) AS n, any_value(b) AS b, sqrt(sum({weight} * x.u * o.u)) AS se, pow(any_value(c), 2) / (sum({weight} * x.q * o.q) * any_value(n) / (any_value(n) - any_value(k))) AS f FROM {r}_s x JOIN {r}_s o ON o.rn BETWEEN x.rn - {h + p} AND x.rn, {r}_b)"
    return r, ", ".join([base, one, scores, both])


def _lp_iv(horizons: int, cumulate: bool, digits: int = 6, p: int = 4) -> str:
    parts, out = [], []
    for h in range(horizons + 1):
        r, text = _instrumented(h, p, cumulate)
        parts.append(text)
        rows = [("horizons", (h,), str(h)), ("multiplier" if cumulate else "irf", (h,), "b"), ("se", (h,), "se"), ("first_stage_f", (h,), "f")]
        out.append(Q.fields(r, rows + ([("nobs_per_h", (h,), "n")] if cumulate else []), digits))
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


def _lp_state(horizons: int, p: int = 4) -> str:
    parts, out = [], []
    inner = ["z", "1.0", *(f"y_{j}" for j in range(1, p + 1))]
    for h in range(horizons + 1):
        source = f"SELECT * FROM (SELECT g, t, lead(y, {h}) OVER (ORDER BY t) AS target, z, lag(high) OVER (ORDER BY t) AS s, {lags('y', p)} FROM ({MONTHS})) WHERE target IS NOT NULL AND y_{p} IS NOT NULL"
        xs = [f"{x} * s" for x in inner] + [f"{x} * (1 - s)" for x in inner]
        parts += [Q.least_squares(f"f{h}", source, ["target"], xs), Q.robust(f"r{h}", f"f{h}", len(xs), str(h + p), only=[0, p + 2])]
        out.append(Q.fields(f"r{h}", [("horizons", (h,), str(h)), ("irf_state1", (h,), "b0"), ("se_state1", (h,), "se0"), ("irf_state0", (h,), f"b{p + 2}"), ("se_state0", (h,), f"se{p + 2}")]))
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


def _panel_lp(horizon: int, p: int = 2, bandwidth: int = 4) -> str:
    """Unit effects by demeaning; errors from sums over units, by day."""
    parts, out = [], []
    for h in range(horizon + 1):
        names = ["s0", *(f"y_{j}" for j in range(1, p + 1)), *(f"s0_{j}" for j in range(1, p + 1))]
        rows = f"SELECT * FROM (SELECT unit, t, lead(y, {h}) OVER w AS target, s0, {', '.join(f'lag({c}, {j}) OVER w AS {c}_{j}' for c in ('y', 's0') for j in range(1, p + 1))} FROM (SELECT *, sin(day * day) AS s0 FROM ({PANEL})) WINDOW w AS (PARTITION BY unit ORDER BY t)) WHERE target IS NOT NULL AND y_{p} IS NOT NULL"
        demeaned = f"SELECT 0 AS g, (t, unit) AS t, t AS day, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY unit) AS {c}' for c in ['target', *names])} FROM ({rows})"
        f = f"f{h}"
        parts.append(Q.least_squares(f, demeaned, ["target"], names))
        parts.append(f"d{h} AS (SELECT day, row_number() OVER (ORDER BY day) AS rn, u FROM (SELECT struct_extract_at(t, 1) AS day, sum(e0 * c0) AS u FROM {f} GROUP BY 1))")
        weight = f"CASE WHEN x.rn = o.rn THEN 1.0 ELSE 2 * (1 - (x.rn - o.rn) / {bandwidth + 1}.0) END"
        parts.append(f"r{h} AS (SELECT (SELECT any_value(b0_0) FROM {f}) AS b, (SELECT any_value(n) FROM {f}) AS n, sqrt(sum({weight} * x.u * o.u)) AS se FROM d{h} x JOIN d{h} o ON o.rn BETWEEN x.rn - {bandwidth} AND x.rn)")
        out.append(Q.fields(f"r{h}", [("irf", (h,), "b"), ("se", (h,), "se"), ("nobs", (h,), "n")]))
    out.append(Q.fields("(SELECT 1)", [("se_type", (), None, "driscoll_kraay"), ("cumulative", (), "0"), ("jackknife", (), "0")]))
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


def _segments(column: str, source: str, size: int = 256) -> str:
    """s: windowed values by segment (half overlapping), q: sums with cosines and sines."""
    rows = f"z AS (SELECT {column}, row_number() OVER (ORDER BY t) - 1 AS j FROM ({source})), o AS (SELECT unnest(range(0, (SELECT count(*) FROM z) - {size} + 1, {size // 2})) AS a)"
    return f"{rows}, s AS (SELECT a, j - a AS i, {{values}} FROM z JOIN o ON j BETWEEN a AND a + {size - 1}), w AS (SELECT unnest(range(0, {size // 2 + 1})) AS b)"


def _hann(size: int) -> str:
    return f"(0.5 - 0.5 * cos(2 * pi() * (j - a) / {size}))"


def _scale(size: int) -> float:
    return sum((0.5 - 0.5 * math.cos(2 * math.pi * j / size)) ** 2 for j in range(size))


def _welch(size: int = 256) -> str:
    base = _segments("r", RETURNS, size).format(values=f"r * {_hann(size)} AS v")
    power = f"r AS (SELECT b, avg(p) * CASE WHEN b = 0 OR b = {size // 2} THEN 1 ELSE 2 END / {_scale(size)!r} AS psd FROM (SELECT a, b, pow(sum(v * cos(2 * pi() * b * i / {size})), 2) + pow(sum(v * sin(2 * pi() * b * i / {size})), 2) AS p FROM s, w GROUP BY 1, 2) GROUP BY 1)"
    return f"WITH {base}, {power} {Q.fields('r', [('freqs', ('b',), f'b / {size}.0'), ('psd', ('b',), 'psd')])}"


def _coherence(size: int = 256) -> str:
    base = _segments("y, x1", REGRESSION, size).format(values=f"y * {_hann(size)} AS v, x1 * {_hann(size)} AS u")
    sums = ", ".join(f"sum({c} * {f}(2 * pi() * b * i / {size})) AS {c}{f[0]}" for c in "vu" for f in ("cos", "sin"))
    one = f"q AS (SELECT a, b, {sums} FROM s, w GROUP BY 1, 2), r AS (SELECT b, (pow(avg(vc * uc + vs * us), 2) + pow(avg(vc * us - vs * uc), 2)) / (avg(vc * vc + vs * vs) * avg(uc * uc + us * us)) AS c FROM q GROUP BY 1)"
    return f"WITH {base}, {one} {Q.fields('r', [('freqs', ('b',), f'b / {size}.0'), ('coherence', ('b',), 'c')])}"


def _gph() -> str:
    base = f"s AS (SELECT r2 - avg(r2) OVER () AS d, row_number() OVER (ORDER BY t) - 1 AS j, count(*) OVER () AS n FROM ({RETURNS})), w AS (SELECT DISTINCT n, unnest(range(1, CAST(floor(sqrt(n)) AS BIGINT) + 1)) AS b FROM s)"
    power = "p AS (SELECT 0 AS g, b AS t, -2 * ln(2 * sin(pi() * b / any_value(w.n))) AS x, ln((pow(sum(d * cos(2 * pi() * b * j / w.n)), 2) + pow(sum(d * sin(2 * pi() * b * j / w.n)), 2)) / (2 * pi() * any_value(w.n))) AS f FROM s, w GROUP BY b)"
    fit = Q.least_squares("f", "SELECT * FROM p", ["f"], ["1.0", "x"])
    one = "r AS (SELECT any_value(b0_1) AS d, any_value(v1_1) AS v, any_value(ssr0) AS ssr, any_value(n) AS m FROM f)"
    rows = [("d", (), "d"), ("se", (), "sqrt(pi() * pi() / 6 * v)"), ("se_asymptotic", (), "pi() / sqrt(24.0 * m)"), ("se_regression", (), "sqrt(v * ssr / (m - 2))"), ("m", (), "m")]
    return f"WITH {base}, {power}, {fit}, {one} {Q.fields('r', rows)}"


def _cusum() -> str:
    """One-step errors from running sums of a constant and one regressor."""
    sums = ", ".join(f"sum({x}) OVER q AS {n}" for n, x in (("sn", "1.0"), ("sx", "n_"), ("sxx", "n_ * n_"), ("sy", "y"), ("sxy", "n_ * y")))
    base = f"s AS (SELECT y, n_ AS x, row_number() OVER (ORDER BY t) AS rn, {sums} FROM ({MONTHS}) WINDOW q AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    one = "b AS (SELECT rn - 3 AS i, (y - (sy - s1 * sx) / sn - s1 * x) / sqrt(1 + (sxx - 2 * x * sx + x * x * sn) / (sn * sxx - sx * sx)) AS w FROM (SELECT *, (sn * sxy - sx * sy) / (sn * sxx - sx * sx) AS s1 FROM s WHERE rn > 2)), r AS (SELECT i, sum(w) OVER (ORDER BY i) AS c, (SELECT stddev_samp(w) FROM b) AS sigma, (SELECT count(*) FROM b) AS m FROM b)"
    bound = "0.948 * (sqrt(m) + 2 * (i + 1) / sqrt(m))"
    return f"WITH {base}, {one} {Q.fields('r', [('path', ('i',), 'c / sigma'), ('bound_upper', ('i',), bound), ('bound_lower', ('i',), f'-({bound})')])} UNION ALL {Q.fields('(SELECT * FROM r LIMIT 1)', [('sigma', (), 'sigma')])}"


def _hp(lamb: float = 1600.0) -> str:
    """Elimination downwards and substitution upwards of the five-band system."""
    base = f"s AS (SELECT y, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM ({MONTHS}))"
    d0 = f"(1 + {lamb} * CASE WHEN i IN (1, n) THEN 1 WHEN i IN (2, n - 1) THEN 5 ELSE 6 END)"
    d1 = f"({lamb} * CASE WHEN i IN (1, n - 1) THEN -2 ELSE -4 END)"
    none = "CAST(0 AS DOUBLE)"
    start = f"SELECT i, n, CAST({d0} AS DOUBLE) AS d, CAST({d1} / {d0} AS DOUBLE) AS l1, CAST({lamb} / {d0} AS DOUBLE) AS l2, y AS z, {none} AS pd, {none} AS pl1, {none} AS pl2, {none} AS pz FROM s WHERE i = 1"
    d = f"({d0.replace('(1, n)', '(1, s.n)').replace('i IN', 's.i IN').replace('n - 1', 's.n - 1')} - q.l1 * q.l1 * q.d - q.pl2 * q.pl2 * q.pd)"
    off = d1.replace("i IN", "s.i IN").replace("n - 1", "s.n - 1")
    step = f"SELECT s.i, s.n, {d}, ({off} - q.l1 * q.l2 * q.d) / {d}, {lamb} / {d}, s.y - q.l1 * q.z - q.pl2 * q.pz, q.d, q.l1, q.l2, q.z FROM q JOIN s ON s.i = q.i + 1"
    back = "x AS (SELECT i, z / d AS v, CAST(0 AS DOUBLE) AS after FROM q WHERE i = n UNION ALL SELECT q.i, q.z / q.d - q.l1 * x.v - CASE WHEN q.i < q.n - 1 THEN q.l2 * x.after ELSE 0 END, x.v FROM x JOIN q ON q.i = x.i - 1)"
    return f"WITH RECURSIVE {base}, q AS ({start} UNION ALL {step}), {back}, r AS (SELECT x.i - 1 AS i, v, y FROM x JOIN s USING (i)) {Q.fields('r', [('trend', ('i',), 'v'), ('cycle', ('i',), 'y - v')])}"


def _afns(sigma: Sequence[float], decay: float = 0.0609) -> str:
    """The integrals in closed form."""
    months = [1, 2, 3, 6, 7, 12, 13, 24, 36]
    points = f"SELECT t AS g, m * 1.0 AS m, row_number() OVER (PARTITION BY t ORDER BY m) - 1 AS i FROM ({MONTHS}), (SELECT unnest({months}) AS m)"
    c = repr(decay)
    b2 = f"((m - 2 * (1 - exp(-{c} * m)) / {c} + (1 - exp(-2 * {c} * m)) / (2 * {c})) / ({c} * {c}))"
    se = lambda k: f"(1 / ({k} * {k}) - exp(-{k} * m) * (m / {k} + 1 / ({k} * {k})))"
    k = f"(2 * {c})"
    s2 = f"(2 / ({k} * {k} * {k}) - exp(-{k} * m) * (m * m / {k} + 2 * m / ({k} * {k}) + 2 / ({k} * {k} * {k})))"
    b3 = f"({b2} - 2 * ({se(c)} - {se(k)}) / {c} + {s2})"
    value = f"-({sigma[0] ** 2!r} * m * m * m / 3 + {sigma[1] ** 2!r} * {b2} + {sigma[2] ** 2!r} * {b3}) / (2 * m)"
    return f"WITH r AS ({points}) {Q.fields('r', [('adjustment', ('i',), value), ('maturities', ('i',), 'm')], key='t')}"


def poly(row: Sequence[float], x: str) -> str:
    return "(" + " + ".join(f"({v!r}) * pow({x}, {i})" for i, v in enumerate(row)) + ")"


def _perron() -> str:
    star, _, _, small, large, crit = T.MACKINNON["c"]
    source = f"SELECT * FROM (SELECT g, t, y, lag(y) OVER (ORDER BY t) AS p FROM ({MONTHS})) WHERE p IS NOT NULL"
    base = Q.least_squares("f", source, ["y"], ["p", "1.0"])
    lrv = "l AS (SELECT any_value(f.n) AS n, any_value(lags) AS lags FROM (SELECT *, ceil(12 * pow(n / 100.0, 0.25)) AS lags FROM f) f), q AS (SELECT sum(CASE WHEN a.rn = b.rn THEN 1.0 ELSE 2 * (1 - (a.rn - b.rn) / (lags + 1)) END * a.e0 * b.e0) / any_value(l.n) AS lam FROM f a JOIN f b ON b.rn <= a.rn, l WHERE a.rn - b.rn <= lags)"
    one = "h AS (SELECT any_value(n) AS n, any_value(b0_0) AS b, any_value(v0_0) AS v, any_value(ssr0) AS ssr FROM f), m AS (SELECT h.n AS n, lags, lam, b, ssr / (h.n - 2) AS s2, ssr / h.n AS g0, sqrt(ssr / (h.n - 2) * v) AS sg FROM h, l, q), r0 AS (SELECT n, lags, sqrt(g0 / lam) * (b - 1) / sg - 0.5 * (lam - g0) / sqrt(lam) * n * sg / sqrt(s2) AS z, n * (b - 1) - 0.5 * (n * n * sg * sg / s2) * (lam - g0) AS za FROM m), r AS (SELECT *, " + f"CASE WHEN z <= {star!r} THEN {poly(small, 'z')} ELSE {poly(large, 'z')} END AS x FROM r0)"
    rows = [("stat", (), "z"), ("ztau", (), "z"), ("zalpha", (), "za"), ("pvalue", (), Q.norm_sf("(-x)")), ("lags", (), "lags"), ("nobs", (), "n"), *((f"crit_{c}", (), poly(crit[i], "(1.0 / n)")) for i, c in enumerate((1, 5, 10)))]
    return f"WITH {base}, {lrv}, {one} {Q.fields('r', rows)}"


def _adf(top: int = 9) -> str:
    """Lags by the information criterion on the rows that all lags leave, from the residual sums after each column; then the chosen regression on all its rows."""
    changes = f"SELECT g, t, y, y - lag(y) OVER w AS d, lag(y) OVER w AS p FROM ({S.TYPE_DAYS}) WINDOW w AS (PARTITION BY g ORDER BY t)"
    lagged = f"SELECT *, row_number() OVER (PARTITION BY g ORDER BY t) AS nth, {lags('d', top)} FROM ({changes})"
    names = [f"d_{j}" for j in range(1, top + 1)]
    parts = [Q.least_squares("c", f"SELECT * FROM ({lagged}) WHERE nth > {top + 1}", ["d"], ["1.0", "p", *names])]
    for k in range(top + 1):
        parts.append(f"i{k} AS (SELECT g, {k} AS lag, any_value(n) * (ln(2 * pi()) + ln(sum(e0 * e0) / any_value(n)) + 1) + 2 * {2 + k} AS ic FROM c_{2 + k} GROUP BY g)")
        parts.append(Q.least_squares(f"f{k}", f"SELECT * FROM ({lagged}) WHERE nth > {k + 1}", ["d"], ["p", *names[:k], "1.0"]))
        parts.append(f"t{k} AS (SELECT g, {k} AS lag, any_value(b0_0) / sqrt(any_value(v0_0) * any_value(ssr0) / (any_value(n) - any_value(k))) AS z, any_value(n) AS n FROM f{k} GROUP BY g)")
    union = lambda x: " UNION ALL ".join(f"SELECT * FROM {x}{k}" for k in range(top + 1))
    star, low, high, small, large, crit = T.MACKINNON["c"]
    x = f"(CASE WHEN z <= {star!r} THEN {poly(small, 'z')} ELSE {poly(large, 'z')} END)"
    p = f"CASE WHEN z > {high!r} THEN 1.0 WHEN z < {low!r} THEN 0.0 ELSE {Q.norm_sf("(-x)")} END"
    one = f"b AS (SELECT g, arg_min(lag, ic) AS lag FROM ({union('i')}) GROUP BY g), r AS (SELECT t.g, t.lag AS lag, z, n, {x} AS x FROM ({union('t')}) t JOIN b ON b.g = t.g AND b.lag = t.lag)"
    rows = [("statistic", (), "z"), ("p_value", (), p), ("used_lag", (), "lag"), ("nobs", (), "n"), *((f"crit_{c}", (), poly(crit[i], "(1.0 / n)")) for i, c in enumerate((1, 5, 10)))]
    return f"WITH {', '.join(parts)}, {one} {Q.fields('r', rows, key='g')}"


def _pacf_ols(top: int) -> str:
    parts, out = [], []
    for k in range(1, top + 1):
        source = f"SELECT * FROM (SELECT g, t, y, {lags('y', k)} FROM ({S.TYPE_DAYS})) WHERE y_{k} IS NOT NULL"
        parts.append(Q.least_squares(f"f{k}", source, ["y"], ["1.0", *(f"y_{j}" for j in range(1, k + 1))]))
        out.append(Q.fields(f"(SELECT * FROM f{k} WHERE rn = 1)", [("pacf", (k,), f"b0_{k}")], key="g"))
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)} UNION ALL {Q.fields('(SELECT * FROM f1 WHERE rn = 1)', [('pacf', (0,), '1.0')], key='g')}"


def _pacf(top: int) -> str:
    """The partial autocorrelations by the recursion on autocovariances, written out."""
    base = f"s AS (SELECT g, y - avg(y) OVER (PARTITION BY g) AS d, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY t) AS rn FROM ({S.TYPE_DAYS}))"
    sums = ", ".join(f"sum(d * d{k}) / any_value(n) AS r{k}" for k in range(top + 1))
    lagged = ", ".join(f"lag(d, {k}) OVER (PARTITION BY g ORDER BY rn) AS d{k}" for k in range(top + 1))
    steps = [["r0 AS v0"]]
    for k in range(1, top + 1):
        steps.append([f"(r{k}" + "".join(f" - a{k - 1}_{j} * r{k - j}" for j in range(1, k)) + f") / v{k - 1} AS a{k}_{k}"])
        steps.append([f"v{k - 1} * (1 - a{k}_{k} * a{k}_{k}) AS v{k}", *(f"a{k - 1}_{j} - a{k}_{k} * a{k - 1}_{k - j} AS a{k}_{j}" for j in range(1, k))])
    return f"WITH {base}, c AS (SELECT g, {sums} FROM (SELECT g, d, n, {lagged} FROM s) GROUP BY g), {Q.chain('r', 'c', steps)} {Q.fields('r', [('pacf', (0,), '1.0'), *(('pacf', (k,), f'a{k}_{k}') for k in range(1, top + 1))], key='g')}"


def _predictive(cz: float = -1.0, alpha: float = 0.95) -> str:
    ordered = f"SELECT g, t, y, a, lag(a) OVER (ORDER BY t) AS p, lag(a, 2) OVER (ORDER BY t) AS pp FROM ({MONTHS})"
    base = Q.least_squares("f", f"SELECT * FROM ({ordered}) WHERE p IS NOT NULL", ["y", "a"], ["1.0", "p"])
    heads = "h AS (SELECT any_value(n) AS n, any_value(b0_0) AS b0, any_value(b0_1) AS b1, sqrt(any_value(ssr0) / (any_value(n) - 2) * any_value(v1_1)) AS se, any_value(b1_1) AS rho, sum(e0 * e1) / sum(e1 * e1) AS phi, any_value(ssr0) AS ssr FROM f)"
    # The instrument: near-integrated sums of the regressor's changes.
    rows = f"x AS (SELECT y, p, coalesce(p - pp, 0) AS d, row_number() OVER (ORDER BY t) AS rn, 1 + ({cz}) / pow((SELECT count(*) FROM ({MONTHS})), {alpha}) AS rz FROM ({ordered}) WHERE p IS NOT NULL)"
    z = "z AS (SELECT rn, CAST(0 AS DOUBLE) AS z FROM x WHERE rn = 1 UNION ALL SELECT x.rn, rz * z.z + d FROM z JOIN x ON x.rn = z.rn + 1)"
    ivx = "i AS (SELECT any_value(rz) AS rz, sum(z * (y - my)) / sum(z * (p - mp)) AS b, (SELECT ssr / n FROM h) * (sum(z * z) - sum(z) * sum(z) / count(*)) / pow(sum(z * (p - mp)), 2) AS v FROM (SELECT *, avg(y) OVER () AS my, avg(p) OVER () AS mp FROM x JOIN z USING (rn)))"
    bias = "(-phi * (1 + 3 * rho) / n)"
    out = [("ols.alpha", (), "b0"), ("ols.beta", (), "b1"), ("ols.se", (), "se"), ("ols.tstat", (), "b1 / se"), ("stambaugh.beta_ols", (), "b1"), ("stambaugh.beta_corrected", (), f"b1 - {bias}"), ("stambaugh.bias_term", (), bias), ("stambaugh.rho_ols", (), "rho"), ("ivx.beta_ivx", (), "b"), ("ivx.wald", (), "b * b / v"), ("ivx.pvalue", (), Q.chi2_sf("(b * b / v)", "1")), ("ivx.rz", (), "rz"), ("nobs", (), "n")]
    return f"WITH RECURSIVE {base}, {heads}, {rows}, {z}, {ivx}, r AS (SELECT * FROM h, i) {Q.fields('r', out)}"


def _flp(horizons: int = 8, p: int = 2) -> str:
    parts, out = [], [Q.fields("(SELECT 1)", [("n_factors", (), "2")])]
    for h in range(horizons + 1):
        source = f"SELECT * FROM (SELECT g, t, lead(y, {h}) OVER (ORDER BY t) AS target, n_, a, {lags('y', p)} FROM ({MONTHS})) WHERE target IS NOT NULL AND y_{p} IS NOT NULL"
        weight = f"CASE WHEN x.rn = o.rn THEN 1.0 ELSE 1 - abs(x.rn - o.rn) / {h + p + 1}.0 END * x.e0 * o.e0"
        sums = ", ".join(f"sum({weight} * x.c{i} * o.c{j}) * any_value(x.n) / (any_value(x.n) - any_value(x.k)) AS q{i}_{j}" for i in range(2) for j in range(2))
        parts.append(Q.least_squares(f"f{h}", source, ["target"], ["n_", "a", "1.0", *(f"y_{j}" for j in range(1, p + 1))]))
        parts.append(f"r{h} AS (SELECT any_value(x.n) AS n, any_value(x.b0_0) AS b0, any_value(x.b0_1) AS b1, {sums} FROM f{h} x JOIN f{h} o ON o.rn BETWEEN x.rn - {h + p} AND x.rn + {h + p})")
        rows = [("horizons", (h,), str(h)), ("nobs", (h,), "n")]
        for i in range(2):
            rows += [("betas", (h, i), f"b{i}"), ("se", (h, i), f"sqrt(q{i}_{i})"), *(("covs", (h, i, j), f"q{i}_{j}") for j in range(2))]
        out.append(Q.fields(f"r{h}", rows))
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


SQL: dict[str, tuple[int, str]] = {
    "var_irf": (6, _irf(8)),
    "var_fevd": (6, _fevd(8, False)),
    "structural_fevd": (6, _fevd(10, True)),
    "var_forecast": (6, _forecast(8)),
    "var_granger": (6, _granger()),
    "select_order": (6, _order(4)),
    "connectedness": (6, _connectedness(10)),
    "rolling_connectedness": (6, _rolling(50, 10)),
    "long_run_svar": (6, _long_run(12)),
    "lp_iv": (4, _lp_iv(6, False, 4)),
    "lp_multiplier": (3, _lp_iv(6, True, 3)),
    "lp_state": (6, _lp_state(6)),
    "panel_lp": (6, _panel_lp(3)),
    "flp": (6, _flp()),
    "welch": (6, _welch()),
    "coherence": (6, _coherence()),
    "long_memory_d": (6, _gph()),
    "cusum_test": (6, _cusum()),
    "hp_filter": (6, _hp()),
    "afns_adjustment": (6, _afns((0.01, 0.02, 0.03))),
    "phillips_perron": (6, _perron()),
    "adf": (6, _adf()),
    "pacf": (6, _pacf(8)),
    "pacf_ols": (6, _pacf_ols(6)),
    "predictive_regression": (6, _predictive()),
}
