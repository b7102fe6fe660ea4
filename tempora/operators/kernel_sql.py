"""SQL of the registered kernel queries that SQL can tell, by name: (digits kept, SQL)."""

from __future__ import annotations

from collections.abc import Sequence

from ..sources import series as S
from . import sqlkit as Q

MONTHS = f"SELECT 0 AS g, t, y, n AS n_, a, 1.0 AS c, coalesce(lag(y) OVER (ORDER BY t), y) AS lag1, CASE WHEN y > avg(y) OVER () THEN 1.0 ELSE 0.0 END AS high, n / 100 + sin(month(t)) AS z FROM ({S.MONTHLY})"
REGRESSION = f"SELECT 0 AS g, t, y, c, x1, x2 FROM ({S.REGRESSION})"
RETURNS = f"SELECT 0 AS g, t, r, r * r AS r2 FROM ({S.RETURNS})"
PANEL = f"SELECT dense_rank() OVER (ORDER BY g) AS unit, t, y, x, CAST(date_diff('day', DATE '2024-01-01', t) AS DOUBLE) AS day FROM ({S.TYPE_DAYS})"
X = ["c", "x1", "x2"]
K = range(3)


def vector(name: str, values: Sequence[str]) -> list[tuple]:
    return [(name, (i,), v) for i, v in enumerate(values)]


def table(k: int) -> list[tuple]:
    """params, bse and tvalues of a robust table."""
    return vector("params", [f"b{i}" for i in range(k)]) + vector("bse", [f"se{i}" for i in range(k)]) + vector("tvalues", [f"b{i} / se{i}" for i in range(k)])


def lags(column: str, upto: int, by: str = "g") -> str:
    return ", ".join(f"lag({column}, {j}) OVER (PARTITION BY {by} ORDER BY t) AS {column}_{j}" for j in range(1, upto + 1))


def ratio_test(base: str, source: str, rows: list[tuple]) -> str:
    return f"WITH {base}, r AS ({source}) {Q.fields('r', rows)}"


_LS = Q.least_squares("f", REGRESSION, ["y"], X)
_ONE = "SELECT any_value(n) AS n, any_value(k) AS k, any_value(ssr0) AS ssr, sum(y0 * y0) - sum(y0) * sum(y0) / count(*) AS tss FROM"


def _ols(kind: str) -> str:
    return f"WITH {_LS}, {Q.robust('r', 'f', 3, kind=kind)} {Q.fields('r', [*table(3), ('se_type', (), None, kind)])}"


def _auxiliary(regressors: list[str], df: int) -> str:
    """n R^2 and F of squared residuals on other columns."""
    second = Q.least_squares("u", "SELECT a.g, a.t, f.e0 * f.e0 AS e, a.c, a.x1, a.x2 FROM src a JOIN f ON f.t = a.t", ["e"], regressors)
    stat, f = "(n * (1 - ssr / tss))", f"(((1 - ssr / tss) / {df}) / ((ssr / tss) / (n - {df} - 1)))"
    rows = [("statistic", (), stat), ("df", (), str(df)), ("pvalue", (), Q.chi2_sf(stat, str(df))), ("fstat", (), f), ("f_pvalue", (), Q.f_sf(f, str(df), f"(n - {df} - 1)"))]
    return f"WITH src AS MATERIALIZED ({REGRESSION}), {_LS}, {second}, r AS ({_ONE} u) {Q.fields('r', rows)}"


def _reset() -> str:
    second = Q.least_squares("u", "SELECT a.g, a.t, a.y, a.c, a.x1, a.x2, (f.y0 - f.e0) AS p FROM src a JOIN f ON f.t = a.t", ["y"], [*X, "p * p", "p * p * p"])
    f = "(((s0 - s1) / 2) / (s1 / (n - 5)))"
    rows = [("fstat", (), f), ("df_num", (), "2"), ("df_den", (), "n - 5"), ("pvalue", (), Q.f_sf(f, "2", "(n - 5)"))]
    return f"WITH src AS MATERIALIZED ({REGRESSION}), {_LS}, {second}, r AS (SELECT any_value(u.n) AS n, any_value(f.ssr0) AS s0, any_value(u.ssr0) AS s1 FROM u JOIN f ON f.rn = u.rn) {Q.fields('r', rows)}"


def _chow(split: int) -> str:
    source = f"SELECT *, row_number() OVER (ORDER BY t) AS place FROM ({MONTHS})"
    parts = [Q.least_squares("p", source, ["y"], ["c", "n_"]), Q.least_squares("q", f"SELECT * REPLACE (CASE WHEN place <= {split} THEN 1 ELSE 2 END AS g) FROM ({source})", ["y"], ["c", "n_"])]
    one = "r AS (SELECT (SELECT any_value(n) FROM p) AS n, (SELECT any_value(ssr0) FROM p) AS s, (SELECT any_value(ssr0) FROM q WHERE g = 1) AS s1, (SELECT any_value(ssr0) FROM q WHERE g = 2) AS s2)"
    f = "(((s - s1 - s2) / 2) / ((s1 + s2) / (n - 4)))"
    rows = [("fstat", (), f), ("df_num", (), "2"), ("df_den", (), "n - 4"), ("pvalue", (), Q.f_sf(f, "2", "(n - 4)")), ("ssr_pooled", (), "s"), ("ssr1", (), "s1"), ("ssr2", (), "s2")]
    return f"WITH {', '.join(parts)}, {one} {Q.fields('r', rows)}"


def _arch(q: int) -> str:
    source = f"SELECT * FROM (SELECT g, t, r2, {lags('r2', q)} FROM ({RETURNS})) WHERE r2_{q} IS NOT NULL"
    stat = "(n * (1 - ssr / tss))"
    rows = [("statistic", (), stat), ("p_value", (), Q.chi2_sf(stat, str(q))), ("df", (), str(q)), ("nobs", (), "n")]
    return f"WITH {Q.least_squares('f', source, ['r2'], ['1.0', *(f'r2_{j}' for j in range(1, q + 1))])}, r AS ({_ONE} f) {Q.fields('r', rows)}"


def _hamilton(h: int = 8, p: int = 4) -> str:
    names = [f"lag(y, {h + j}) OVER (ORDER BY t) AS l{j}" for j in range(p)]
    source = f"SELECT * FROM (SELECT g, t, y, {', '.join(names)} FROM ({MONTHS})) WHERE l{p - 1} IS NOT NULL"
    base = Q.least_squares("f", source, ["y"], ["1.0", *(f"l{j}" for j in range(p))])
    rows = Q.fields("(SELECT * FROM f WHERE rn = 1)", [*vector("beta", [f"b0_{i}" for i in range(p + 1)]), ("first_index", (), str(h + p - 1))])
    return f"WITH {base} {rows} UNION ALL {Q.fields('f', [('cycle', ('rn - 1',), 'e0'), ('trend', ('rn - 1',), 'y0 - e0')])}"


def _har() -> str:
    source = f"SELECT * FROM (SELECT g, t, r2, lag(r2) OVER w AS d, avg(r2) OVER (w ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS s5, avg(r2) OVER (w ROWS BETWEEN 23 PRECEDING AND 2 PRECEDING) AS s22, row_number() OVER w AS place FROM ({RETURNS}) WINDOW w AS (PARTITION BY g ORDER BY t)) WHERE place > 23"
    return source


def _simple_table(source: str, y: str, xs: list[str], rows: list[tuple], digits: int = 6, lags_: str = Q.LAGS) -> str:
    return f"WITH {Q.least_squares('f', source, [y], xs)}, {Q.robust('r', 'f', len(xs), lags_)} {Q.fields('r', rows, digits)}"


def _lp(horizons: int = 6, p: int = 4) -> str:
    parts, out = [], []
    for h in range(horizons + 1):
        source = f"SELECT * FROM (SELECT g, t, lead(y, {h}) OVER (ORDER BY t) AS target, z, {lags('y', p)} FROM ({MONTHS})) WHERE target IS NOT NULL AND y_{p} IS NOT NULL"
        parts += [Q.least_squares(f"f{h}", source, ["target"], ["z", "1.0", *(f"y_{j}" for j in range(1, p + 1))]), Q.robust(f"r{h}", f"f{h}", p + 2, str(h + p), only=[0])]
        out.append(Q.fields(f"r{h}", [("horizons", (h,), str(h)), ("irf", (h,), "b0"), ("se", (h,), "se0")]))
    out.append(Q.fields("(SELECT 1)", [("se_method", (), None, "hac")]))
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(out)}"


def _panel_fe() -> str:
    within = f"SELECT 0 AS g, (unit, t) AS t, unit, y - avg(y) OVER (PARTITION BY unit) AS y, x - avg(x) OVER (PARTITION BY unit) AS x, day - avg(day) OVER (PARTITION BY unit) AS day FROM ({PANEL})"
    clusters = "q AS (SELECT sum(a * a) AS v0, sum(b * b) AS v1, any_value(n) AS n, count(*) AS units, any_value(b0_0) AS b0, any_value(b0_1) AS b1 FROM (SELECT t.unit, sum(e0 * c0) AS a, sum(e0 * c1) AS b, any_value(n) AS n, any_value(b0_0) AS b0_0, any_value(b0_1) AS b0_1 FROM (SELECT *, struct_extract_at(t, 1) AS u FROM f) f, LATERAL (SELECT f.u AS unit) t GROUP BY 1))"
    scale = "(units / (units - 1.0)) * (n - 1.0) / (n - 2)"
    one = f"r AS (SELECT b0, b1, sqrt(v0 * {scale}) AS se0, sqrt(v1 * {scale}) AS se1 FROM q)"
    return f"WITH {Q.least_squares('f', within, ['y'], ['x', 'day'])}, {clusters}, {one} {Q.fields('r', [*table(2), ('se_type', (), None, 'cluster')])}"


def _mean_group() -> str:
    source = f"SELECT unit AS g, t, y, x FROM ({PANEL})"
    one = "u AS (SELECT g, any_value(b0_0) AS b FROM f GROUP BY 1), r AS (SELECT avg(b) AS m, stddev_samp(b) / sqrt(count(*)) AS se, count(*) AS units FROM u)"
    rows = [("coef", (0,), "m"), ("se", (0,), "se"), ("tstat", (0,), "m / se"), ("n_units", (), "units"), ("k", (), "1")]
    return f"WITH {Q.least_squares('f', source, ['y'], ['x', '1.0'])}, {one} {Q.fields('r', rows)} UNION ALL {Q.fields('u', [('coef_per_unit', ('g - 1', 0), 'b')])}"


def _ridge(alpha: float = 1.0) -> str:
    """Rows of the penalty below the data: sqrt(alpha) for one coefficient, target 0."""
    more = " UNION ALL ".join(f"SELECT 0, NULL, 0.0, {', '.join(f'{alpha**0.5}' if j == i else '0.0' for j in K)}" for i in K)
    base = Q.least_squares("f", f"SELECT g, t, y, c, x1, x2 FROM ({REGRESSION}) UNION ALL {more}", ["y"], X)
    return f"WITH {base} {Q.fields('(SELECT * FROM f WHERE rn = 1)', vector('coef', [f'b0_{i}' for i in K]))}"


def _periodogram() -> str:
    base = f"s AS (SELECT y - avg(y) OVER () AS d, row_number() OVER (ORDER BY t) - 1 AS j, count(*) OVER () AS n FROM ({MONTHS})), f AS (SELECT DISTINCT n, unnest(range(0, n // 2 + 1)) AS q FROM s)"
    power = "r AS (SELECT q, f.n AS n, pow(sum(d * cos(2 * pi() * q * j / f.n)), 2) + pow(sum(d * sin(2 * pi() * q * j / f.n)), 2) AS p FROM s, f GROUP BY 1, 2)"
    return f"WITH {base}, {power} {Q.fields('r', [('freqs', ('q',), 'q / CAST(n AS DOUBLE)'), ('psd', ('q',), 'p / n * CASE WHEN q = 0 OR 2 * q = n THEN 1 ELSE 2 END')])}"


def _kpss() -> str:
    base = f"s AS (SELECT g, t, y - avg(y) OVER (PARTITION BY g) AS u, row_number() OVER (PARTITION BY g ORDER BY t) AS rn, count(*) OVER (PARTITION BY g) AS n FROM ({S.TYPE_DAYS}))"
    cov = "c AS (SELECT a.g, any_value(a.n) AS n, a.rn - b.rn AS lag, sum(a.u * b.u) AS v FROM s a JOIN s b ON a.g = b.g AND b.rn <= a.rn GROUP BY a.g, a.rn - b.rn)"
    auto = "m AS (SELECT g, any_value(n) AS n, sum(CASE WHEN lag = 0 THEN v / n WHEN lag <= floor(pow(n, 2.0 / 9)) THEN 2 * v / n ELSE 0 END) AS s0, sum(CASE WHEN lag > 0 AND lag <= floor(pow(n, 2.0 / 9)) THEN lag * 2 * v / n ELSE 0 END) AS s1 FROM c GROUP BY 1), l AS (SELECT g, least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS lags FROM m)"
    lrv = "v AS (SELECT c.g, any_value(lags) AS lags, sum(CASE WHEN lag = 0 THEN v / n WHEN lag <= lags THEN 2 * (1 - lag / (lags + 1)) * v / n ELSE 0 END) AS lrv FROM c JOIN l USING (g) GROUP BY c.g)"
    stat = "p AS (SELECT g, sum(w * w) / (any_value(n) * any_value(n)) AS top FROM (SELECT g, n, sum(u) OVER (PARTITION BY g ORDER BY rn) AS w FROM s) GROUP BY 1), r AS (SELECT g, lags, top / lrv AS s FROM p JOIN v USING (g))"
    # The critical values at 10, 5, 2.5 and 1 %.
    p = "CASE WHEN s <= 0.347 THEN 0.1 WHEN s < 0.463 THEN 0.1 + (s - 0.347) / (0.463 - 0.347) * (0.05 - 0.1) WHEN s < 0.574 THEN 0.05 + (s - 0.463) / (0.574 - 0.463) * (0.025 - 0.05) WHEN s < 0.739 THEN 0.025 + (s - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) ELSE 0.01 END"
    return f"WITH {base}, {cov}, {auto}, {lrv}, {stat} {Q.fields('r', [('statistic', (), 's'), ('p_value', (), p), ('lags', (), 'lags')], key='g')}"


def _local_level(eps: float, eta: float) -> str:
    first = f"s AS (SELECT y, row_number() OVER (ORDER BY t) AS rn, count(*) OVER () AS n FROM ({MONTHS}))"
    filt = f"f(rn, a, p, ll) AS (SELECT rn, y, CAST({eps} AS DOUBLE), -0.5 * ln(2 * pi()) FROM s WHERE rn = 1 UNION ALL SELECT s.rn, f.a + (p + {eta}) / (p + {eta} + {eps}) * (y - f.a), (p + {eta}) - pow(p + {eta}, 2) / (p + {eta} + {eps}), -0.5 * (ln(2 * pi() * (p + {eta} + {eps})) + pow(y - f.a, 2) / (p + {eta} + {eps})) FROM f JOIN s ON s.rn = f.rn + 1)"
    smooth = f"b(rn, s, v) AS (SELECT rn, a, p FROM f WHERE rn = (SELECT max(rn) FROM s) UNION ALL SELECT f.rn, f.a + f.p / (f.p + {eta}) * (b.s - f.a), f.p + pow(f.p / (f.p + {eta}), 2) * (b.v - f.p - {eta}) FROM b JOIN f ON f.rn = b.rn - 1)"
    rows = [("filtered_state", ("rn - 1",), "a"), ("filtered_state_var", ("rn - 1",), "p")]
    return f"WITH RECURSIVE {first}, {filt}, {smooth} {Q.fields('f', rows)} UNION ALL {Q.fields('b', [('smoothed_state', ('rn - 1',), 's'), ('smoothed_state_var', ('rn - 1',), 'v')])} UNION ALL {Q.fields('(SELECT sum(ll) AS ll FROM f)', [('loglik', (), 'll'), ('d_diffuse', (), '1')])}"


def _ar2_loglik(a: float, b: float, s2: float) -> str:
    """The first two rows by their stationary law, the others by their prediction errors."""
    g0 = (1 - b) / ((1 + b) * ((1 - b) ** 2 - a**2))
    rho = a / (1 - b)
    base = f"s AS (SELECT r, lag(r) OVER (ORDER BY t) AS p, lag(r, 2) OVER (ORDER BY t) AS q, row_number() OVER (ORDER BY t) AS rn FROM ({RETURNS}))"
    v = f"CASE rn WHEN 1 THEN r WHEN 2 THEN r - ({rho!r}) * p ELSE r - ({a!r}) * p - ({b!r}) * q END"
    f = f"CASE rn WHEN 1 THEN {g0 * s2!r} WHEN 2 THEN {g0 * (1 - rho * rho) * s2!r} ELSE {s2!r} END"
    return f"WITH {base}, r AS (SELECT sum(-0.5 * (ln(2 * pi() * ({f})) + pow({v}, 2) / ({f}))) AS ll FROM s) {Q.fields('r', [('loglik', (), 'll')], 4)}"


def _cf(low: float = 6.0, high: float = 32.0) -> str:
    a, b = f"(2 * pi() / {high})", f"(2 * pi() / {low})"
    w = lambda j: f"CASE WHEN {j} = 0 THEN ({b} - {a}) / pi() ELSE (sin({b} * ({j})) - sin({a} * ({j}))) / (pi() * ({j})) END"
    base = f"s0 AS (SELECT y, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n, first(y) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0, last(y) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y1 FROM ({MONTHS})), s AS (SELECT y, i, n, y - i * (y1 - y0) / (n - 1) AS x FROM s0)"
    # Inner weights, and at each end what makes the weights of that side sum to nothing.
    inner = f"m AS (SELECT a.i AS i, sum({w('abs(a.i - b.i)')} * b.x) AS v FROM s a JOIN s b ON b.i > 0 AND b.i < b.n - 1 OR b.i = a.i GROUP BY 1)"
    sums = f"e AS (SELECT a.i AS i, any_value(a.y) AS y, coalesce(sum(CASE WHEN b.i > a.i AND b.i < b.n - 1 THEN {w('b.i - a.i')} END), 0) AS up, coalesce(sum(CASE WHEN b.i < a.i AND b.i > 0 THEN {w('a.i - b.i')} END), 0) AS down FROM s a, s b GROUP BY 1)"
    one = f"r AS (SELECT i, y, v + (-0.5 * ({b} - {a}) / pi() - up) * (SELECT x FROM s WHERE i = n - 1) + (-0.5 * ({b} - {a}) / pi() - down) * (SELECT x FROM s WHERE i = 0) AS c FROM m JOIN e USING (i))"
    return f"WITH {base}, {inner}, {sums}, {one} {Q.fields('r', [('cycle', ('i',), 'c'), ('trend', ('i',), 'y - c')])}"


def _curve(decays: Sequence[float], rows: list[tuple]) -> str:
    months = [1, 2, 3, 6, 7, 12, 13, 24, 36]
    points = " UNION ALL ".join(f"SELECT t AS g, {m}.0 AS t, 2.0 + a / 100 + n_ / 400 * exp({-m / 12.0!r}) + y / 100 * {m / 60.0!r} AS v FROM ({MONTHS})" for m in months)
    x = lambda d: f"({d!r} * t)"
    slope = lambda d: f"((1 - exp(-{x(d)})) / {x(d)})"
    columns = ["1.0", slope(decays[0]), *(f"({slope(d)} - exp(-{x(d)}))" for d in decays)]
    base = Q.least_squares("f", points, ["v"], columns)
    one = "r AS (SELECT g, any_value(COLUMNS('b0_.*')), 1 - any_value(ssr0) / (sum(y0 * y0) - sum(y0) * sum(y0) / count(*)) AS r2 FROM f GROUP BY g)"
    return f"WITH {base}, {one} {Q.fields('r', rows, key='t')} UNION ALL {Q.fields('f', [('residuals', ('rn - 1',), 'e0')], key='t')}"


def _var_backtest(alpha: float = 0.05, q: int = 4) -> str:
    xl = lambda k, p: f"(CASE WHEN {k} = 0 THEN 0.0 ELSE {k} * ln({p}) END)"
    hits = f"SELECT 0 AS g, t, CASE WHEN r < -0.6 THEN 1.0 ELSE 0.0 END AS hit FROM ({S.RETURNS})"
    counts = f"h AS ({hits}), b AS (SELECT hit, lag(hit) OVER (ORDER BY t) AS p FROM h), c AS (SELECT count(*) AS n, sum(hit) AS v, count(*) FILTER (WHERE p = 0 AND hit = 0) AS n00, count(*) FILTER (WHERE p = 0 AND hit = 1) AS n01, count(*) FILTER (WHERE p = 1 AND hit = 0) AS n10, count(*) FILTER (WHERE p = 1 AND hit = 1) AS n11 FROM b)"
    source = f"SELECT g, t, hit - {alpha} AS d, {', '.join(f'd{j} - {alpha} AS d{j}' for j in range(1, q + 1))} FROM (SELECT g, t, hit, {', '.join(f'lag(hit, {j}) OVER (ORDER BY t) AS d{j}' for j in range(1, q + 1))} FROM h) WHERE d{q} IS NOT NULL"
    base = Q.least_squares("f", source, ["d"], ["1.0", *(f"d{j}" for j in range(1, q + 1))])
    # b'X'Xb is the sum of squared fits.
    fits = f"d AS (SELECT sum(pow(y0 - e0, 2)) / {alpha * (1 - alpha)!r} AS dq FROM f)"
    probs = "p AS (SELECT *, v / n AS hr, n01 / greatest(1, n00 + n01) AS p01, n11 / greatest(1, n10 + n11) AS p11, (n01 + n11) / (n - 1) AS p2 FROM c, d)"
    uc = f"2 * ({xl('v', 'hr')} + {xl('(n - v)', '(1 - hr)')} - {xl('v', alpha)} - {xl('(n - v)', 1 - alpha)})"
    ind = f"2 * ({xl('n00', '(1 - p01)')} + {xl('n01', 'p01')} + {xl('n10', '(1 - p11)')} + {xl('n11', 'p11')} - {xl('(n00 + n10)', '(1 - p2)')} - {xl('(n01 + n11)', 'p2')})"
    one = f"r AS (SELECT *, {uc} AS uc, {ind} AS ind FROM p)"
    plain = [("n", "n"), ("alpha", str(alpha)), ("n_violations", "v"), ("expected_violations", f"{alpha} * n"), ("hit_rate", "hr"), ("lr_uc", "uc"), ("p_uc", Q.chi2_sf("uc", "1")), ("n00", "n00"), ("n01", "n01"), ("n10", "n10"), ("n11", "n11"), ("pi01", "p01"), ("pi11", "p11"), ("lr_ind", "ind"), ("p_ind", Q.chi2_sf("ind", "1")), ("lr_cc", "uc + ind"), ("p_cc", Q.chi2_sf("(uc + ind)", "2")), ("dq", "dq"), ("p_dq", Q.chi2_sf("dq", str(q + 1)))]
    return f"WITH {counts}, {base}, {fits}, {probs}, {one} {Q.fields('r', [(name, (), v) for name, v in plain])}"


_HAR_ROWS = [*table(4), ("rsquared", (), "r2"), ("nobs", (), "n")]
_CG_ROWS = [("intercept", (), "b0"), ("slope", (), "b1"), ("se_intercept", (), "se0"), ("se_slope", (), "se1"), ("t_slope", (), "b1 / se1"), ("p_slope", (), Q.norm_two_sided("(b1 / se1)")), ("r_squared", (), "r2"), ("implied_rigidity", (), "b1 / (1 + b1)"), ("nobs", (), "n")]

SQL: dict[str, tuple[int, str]] = {
    "ols": (6, _ols("hac")),
    "ols_hc3": (6, _ols("hc3")),
    "heteroskedasticity_test": (6, _auxiliary(["c", "x1", "x2", "x1 * x1", "x1 * x2", "x2 * x2"], 5)),
    "heteroskedasticity_test_bp": (6, _auxiliary(X, 2)),
    "reset_test": (6, _reset()),
    "chow_test": (6, _chow(40)),
    "arch_lm": (6, _arch(4)),
    "hamilton_filter": (6, _hamilton()),
    "har_rv": (6, _simple_table(_har(), "r2", ["1.0", "d", "s5", "s22"], _HAR_ROWS, lags_="5")),
    "umidas": (6, _simple_table(MONTHS, "y", ["1.0", "n_", "a", "lag1"], [*vector("params", [f"b{i}" for i in range(4)]), *vector("bse", [f"se{i}" for i in range(4)]), ("rsquared", (), "r2")])),
    "cg_regression": (6, _simple_table(MONTHS, "y", ["1.0", "n_"], _CG_ROWS)),
    "lp": (6, _lp()),
    "panel_fe": (6, _panel_fe()),
    "panel_mean_group": (6, _mean_group()),
    "ridge": (6, _ridge()),
    "periodogram": (6, _periodogram()),
    "kpss": (6, _kpss()),
    "local_level_smooth": (6, _local_level(4.0, 1.0)),
    "ar_loglik": (4, _ar2_loglik(-0.4, -0.2, 0.1)),
    "cf_filter": (6, _cf()),
    "nelson_siegel": (6, _curve([0.0609], [("level", (), "b0_0"), ("slope", (), "b0_1"), ("curvature", (), "b0_2"), *vector("factors", ["b0_0", "b0_1", "b0_2"]), ("lambda", (), "0.0609"), ("rsquared", (), "r2")])),
    "svensson": (6, _curve([0.0609, 0.3], [*vector("factors", [f"b0_{i}" for i in range(4)]), ("lambda1", (), "0.0609"), ("lambda2", (), "0.3"), ("rsquared", (), "r2")])),
    "var_backtest": (6, _var_backtest()),
}
