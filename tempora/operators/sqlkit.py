"""SQL text for checks of the kernels: least squares by orthogonalising columns with window sums, robust errors, tails of distributions.

A source is a query with columns g (a key, or 0), t (the order) and the columns that the regression names. Least squares go column by
column: each regressor is taken out of the later ones and of the targets, so the last step leaves the residuals, and the factors taken out give the
coefficients and the weights with which each row enters them. This is another way than the kernels', which use QR on arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

NOTHING = "CAST(NULL AS INTEGER)"


def gamma_p(a: str, x: str, terms: int = 500) -> str:
    """The lower regularised incomplete gamma function, a sum of positive terms."""
    return f"CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} > 250 THEN 1.0 ELSE list_sum(list_transform(range(0, {terms}), lambda z: exp(-({x}) + ({a} + z) * ln({x}) - lgamma({a} + z + 1)))) END"


def beta_i(a: str, b: str, x: str, terms: int = 800) -> str:
    """The regularised incomplete beta function for small x, a sum of positive terms."""
    return f"CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum(list_transform(range(0, {terms}), lambda z: exp(({a} + z) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma({a} + {b} + z) - lgamma({a} + z + 1) - lgamma({b})))) END"


def chi2_sf(x: str, df: str) -> str:
    return f"(1 - ({gamma_p(f'({df}) / 2.0', f'(({x}) / 2)')}))"


def f_sf(f: str, d1: str, d2: str) -> str:
    return f"(1 - ({beta_i(f'({d1}) / 2.0', f'({d2}) / 2.0', f'(({d1}) * ({f}) / (({d2}) + ({d1}) * ({f})))')}))"


def norm_two_sided(z: str) -> str:
    return f"(1 - ({gamma_p('0.5', f'(({z}) * ({z}) / 2)')}))"


def norm_sf(z: str) -> str:
    return f"(0.5 - 0.5 * sign({z}) * ({gamma_p('0.5', f'(({z}) * ({z}) / 2)')}))"


def t_two_sided(t: str, df: str) -> str:
    return f"(1 - ({beta_i('0.5', f'({df}) / 2.0', f'(({t}) * ({t}) / (({df}) + ({t}) * ({t})))')}))"


def least_squares(name: str, source: str, ys: Sequence[str], xs: Sequence[str]) -> str:
    """CTEs; the last, ``name``, has for each row g, t, rn, n, k, y0.., e0.. (residuals), ssr0.., b{m}_{i} (coefficient i of target m), c{i} (weight of the row in
    coefficient i), h (leverage), v{i}_{l} (inverse of X'X)."""
    k, m = len(xs), len(ys)
    w = "OVER (PARTITION BY g)"
    keep = ["g", "t", "rn", "n", *(f"y{u}" for u in range(m))]
    start = ", ".join([*(f"CAST({x} AS DOUBLE) AS x{i}" for i, x in enumerate(xs)), *(f"CAST({y} AS DOUBLE) AS y{u}, CAST({y} AS DOUBLE) AS e{u}" for u, y in enumerate(ys))])
    out = [f"{name}_0 AS (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY t) AS rn, count(*) {w} AS n, {start} FROM ({source}))"]
    for i in range(k):
        later = [f"x{j}" for j in range(i + 1, k)] + [f"e{u}" for u in range(m)]
        sums = ", ".join(f"sum(x{i} * {c}) {w} / sum(x{i} * x{i}) {w} AS r{i}_{c}" for c in later)
        got = [c for j in range(i) for c in [f"x{j}", f"d{j}", *(f"r{j}_x{q}" for q in range(j + 1, k)), *(f"r{j}_e{u}" for u in range(m))]]
        made = [f"d{i}", *(f"r{i}_{c}" for c in later)]
        out.append(f"{name}_s{i} AS (SELECT *, sum(x{i} * x{i}) {w} AS d{i}, {sums} FROM {name}_{i})")
        out.append(f"{name}_{i + 1} AS (SELECT {', '.join([*keep, *got, f'x{i}', *made])}, {', '.join(f'{c} - r{i}_{c} * x{i} AS {c}' for c in later)} FROM {name}_s{i})")
    s = lambda i, j: "1.0" if i == j else f"s{i}_{j}"
    steps = []
    for i in reversed(range(k)):
        own = [" - ".join([f"r{i}_e{u}", *(f"r{i}_x{j} * b{u}_{j}" for j in range(i + 1, k))]) + f" AS b{u}_{i}" for u in range(m)]
        own += ["-(" + " + ".join(f"r{i}_x{q} * {s(q, j)}" for q in range(i + 1, j + 1)) + f") AS s{i}_{j}" for j in range(i + 1, k)]
        steps.append(own)
    final = [" + ".join(f"{s(i, j)} * x{j} / d{j}" for j in range(i, k)) + f" AS c{i}" for i in range(k)]
    final += [" + ".join(f"{s(i, j)} * {s(q, j)} / d{j}" for j in range(q, k)) + f" AS v{i}_{q}" for i in range(k) for q in range(i, k)]
    final.append(" + ".join(f"x{j} * x{j} / d{j}" for j in range(k)) + " AS h")
    final += [f"sum(e{u} * e{u}) {w} AS ssr{u}" for u in range(m)]
    got = [f"b{u}_{i}" for u in range(m) for i in range(k)]
    return ", ".join([*out, chain(f"{name}_t", f"{name}_{k}", steps), f"{name} AS MATERIALIZED (SELECT {', '.join(keep)}, {k} AS k, {', '.join(f'e{u}' for u in range(m))}, {', '.join(got + final)} FROM {name}_t)"])


def chain(name: str, source: str, steps: Sequence[Sequence[str]]) -> str:
    """CTEs that add columns step by step, each kept: an expression that names another is not written out in full. The last is ``name``."""
    at = [source, *(f"{name}_{i}" for i in range(len(steps) - 1)), name]
    return ", ".join(f"{to} AS MATERIALIZED (SELECT *, {', '.join(columns)} FROM {of})" for of, to, columns in zip(at, at[1:], steps, strict=False))


#: The default number of lags.
LAGS = "floor(4 * pow(n / 100.0, 2.0 / 9))"


def robust(name: str, base: str, k: int, lags: str = LAGS, kind: str = "hac", correction: bool = True, only: Sequence[int] | None = None) -> str:
    """A CTE with one row a key: g, n, k, b{i}, se{i}, r2, ssr of the first target of a ``least_squares``."""
    which = list(only if only is not None else range(k))
    small = "n / (n - k)" if correction else "1.0"
    if kind == "hac":
        weight = f"CASE WHEN a.rn = b.rn THEN 1.0 ELSE 2 * (1 - (a.rn - b.rn) / (a.lags + 1.0)) END"
        pairs = f"SELECT a.g, {', '.join(f'sum({weight} * a.e0 * a.c{i} * b.e0 * b.c{i}) AS q{i}' for i in which)} FROM (SELECT *, {lags} AS lags FROM {base}) a JOIN {base} b ON a.g = b.g AND b.rn <= a.rn AND b.rn >= a.rn - a.lags GROUP BY 1"
    else:
        over = {"hc0": "1.0", "hc3": "(1 - h) * (1 - h)"}[kind]
        pairs, small = f"SELECT g, {', '.join(f'sum(e0 * e0 * c{i} * c{i} / ({over})) AS q{i}' for i in which)} FROM {base} GROUP BY 1", "1.0"
    heads = f"SELECT g, any_value(n) AS n, any_value(k) AS k, {', '.join(f'any_value(b0_{i}) AS b{i}' for i in which)}, any_value(ssr0) AS ssr, 1 - any_value(ssr0) / (sum(y0 * y0) - sum(y0) * sum(y0) / count(*)) AS r2 FROM {base} GROUP BY 1"
    return f"{name}_q AS ({pairs}), {name}_b AS ({heads}), {name} AS (SELECT g, n, k, r2, ssr, {', '.join(f'b{i}, sqrt(q{i} * {small}) AS se{i}' for i in which)} FROM {name}_b JOIN {name}_q USING (g))"


def fields(source: str, rows: Sequence[tuple], digits: int = 6, key: str | None = None) -> str:
    """Rows (field, i, j, k, value, note) of a one-row-a-key table; a row is (field, indices, value) or (field, indices, None, note)."""
    parts = []
    for field, at, value, *note in rows:
        index = [f"CAST({x} AS INTEGER)" for x in at] + [NOTHING] * (3 - len(at))
        number = f"round(CAST({value} AS DOUBLE), {digits}) + 0.0" if value is not None else "CAST(NULL AS DOUBLE)"
        text = f"'{note[0]}'" if note else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT {f'g AS {key}, ' if key else ''}'{field}' AS field, {index[0]} AS i, {index[1]} AS j, {index[2]} AS k, {number} AS value, {text} AS note FROM {source}")
    return " UNION ALL ".join(parts)
