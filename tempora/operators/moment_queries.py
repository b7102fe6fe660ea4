"""Queries of the windowed and aggregated operators over the given tables, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..sources import series as S
from . import moment_ops as M
from . import sqlkit as Q
from .registry import query, rounded

#: A keyed series with its row numbers and demeaned values, for lag products in SQL.
_LAGGED = f"s AS (SELECT g, y - avg(y) OVER (PARTITION BY g) AS d, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY t) AS rn FROM ({S.TYPE_DAYS}))"


def _autocov(lags: int) -> str:
    return (
        f"{_LAGGED}, k AS (SELECT unnest(range(0, {lags + 1})) AS lag), "
        "c AS (SELECT a.g, a.n, k.lag, sum(a.d * b.d) AS v FROM k, s a JOIN s b ON a.g = b.g WHERE b.rn = a.rn - k.lag GROUP BY 1, 2, 3), "
        "z AS (SELECT g, v AS c0 FROM c WHERE lag = 0)"
    )


@query(
    "acf",
    f"WITH {_autocov(10)}, r AS (SELECT g, n, CAST(lag AS INTEGER) AS lag, v / c0 AS acf FROM c JOIN z USING (g)) "
    "SELECT g, lag, round(acf, 6) + 0.0 AS acf, round(CASE WHEN lag = 0 THEN 0 ELSE sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf ELSE 0 END) OVER (PARTITION BY g ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n) END, 6) + 0.0 AS bartlett_se FROM r",
)
def acf(spark, d):
    return rounded(M.acf(S.type_days(spark, d), "y", "t", ["g"], nlags=10))


@query(
    "acf_daily",
    f"WITH s AS (SELECT r - avg(r) OVER () AS d, row_number() OVER (ORDER BY t) AS rn FROM ({S.RETURNS})), k AS (SELECT unnest(range(0, 21)) AS lag), "
    "c AS (SELECT k.lag, sum(a.d * b.d) AS v FROM k, s a, s b WHERE b.rn = a.rn - k.lag GROUP BY 1) "
    "SELECT CAST(lag AS INTEGER) AS lag, round(v / (SELECT v FROM c WHERE lag = 0), 6) + 0.0 AS acf FROM c",
)
def acf_daily(spark, d):
    return rounded(M.acf(S.returns(spark, d), "r", "t", nlags=20).drop("bartlett_se"))


@query(
    "ljung_box_stat",
    f"WITH {_autocov(8)}, q AS (SELECT g, n, lag, (v / c0) * (v / c0) AS sq FROM c JOIN z USING (g) WHERE lag > 0) "
    "SELECT g, CAST(lag AS INTEGER) AS lag, round(n * (n + 2) * sum(sq / (n - lag)) OVER w, 6) + 0.0 AS lb_stat, round(n * sum(sq) OVER w, 6) + 0.0 AS bp_stat FROM q WINDOW w AS (PARTITION BY g ORDER BY lag)",
)
def ljung_box_stat(spark, d):
    return rounded(M.ljung_box(S.type_days(spark, d), "y", "t", ["g"], nlags=8).drop("lb_pvalue", "bp_pvalue"))


@query(
    "ljung_box",
    f"WITH {_autocov(8)}, q AS (SELECT g, n, lag, (v / c0) * (v / c0) AS sq FROM c JOIN z USING (g) WHERE lag > 0), b AS (SELECT g, lag, n * (n + 2) * sum(sq / (n - lag)) OVER w AS lb, n * sum(sq) OVER w AS bp FROM q WINDOW w AS (PARTITION BY g ORDER BY lag)) "
    f"SELECT g, CAST(lag AS INTEGER) AS lag, round(lb, 6) + 0.0 AS lb_stat, round({Q.chi2_sf('lb', 'lag')}, 6) + 0.0 AS lb_pvalue, round(bp, 6) + 0.0 AS bp_stat, round({Q.chi2_sf('bp', 'lag')}, 6) + 0.0 AS bp_pvalue FROM b",
)
def ljung_box(spark, d):
    return rounded(M.ljung_box(S.type_days(spark, d), "y", "t", ["g"], nlags=8))


@query(
    "jarque_bera",
    "WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_quantity) AS mu FROM lineitem GROUP BY 1), "
    "p AS (SELECT l_returnflag AS g, any_value(n) AS n, avg(pow(l_quantity - mu, 2)) AS m2, avg(pow(l_quantity - mu, 3)) AS m3, avg(pow(l_quantity - mu, 4)) AS m4 FROM lineitem JOIN m ON g = l_returnflag GROUP BY 1), "
    "q AS (SELECT g, n, m3 / pow(m2, 1.5) AS s, m4 / (m2 * m2) AS k FROM p) "
    "SELECT g, round(n / 6.0 * (s * s + pow(k - 3, 2) / 4), 4) + 0.0 AS statistic, round(exp(-(n / 6.0 * (s * s + pow(k - 3, 2) / 4)) / 2), 4) + 0.0 AS p_value, round(s, 4) + 0.0 AS skewness, round(k, 4) + 0.0 AS kurtosis, n FROM q",
)
def jarque_bera(spark, d):
    return rounded(M.jarque_bera(S.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", ["g"]), 4)


@query(
    "long_run_variance",
    f"WITH {_autocov(5)} SELECT g, round(sum(CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / 6.0) END * v / n), 6) + 0.0 AS lrv, 5.0::DOUBLE AS bandwidth FROM c GROUP BY 1",
)
def long_run_variance(spark, d):
    return rounded(M.long_run_variance(S.type_days(spark, d), "y", "t", ["g"], bandwidth=5))


@query(
    "long_run_variance_parzen",
    f"WITH {_autocov(4)} SELECT g, round(sum(CASE WHEN lag = 0 THEN 1 ELSE 2 * CASE WHEN lag / 5.0 <= 0.5 THEN 1 - 6 * pow(lag / 5.0, 2) + 6 * pow(lag / 5.0, 3) ELSE 2 * pow(1 - lag / 5.0, 3) END END * v / n), 6) + 0.0 AS lrv, 4.0::DOUBLE AS bandwidth FROM c GROUP BY 1",
)
def long_run_variance_parzen(spark, d):
    return rounded(M.long_run_variance(S.type_days(spark, d), "y", "t", ["g"], kernel="parzen", bandwidth=4))


def _bk_sql() -> str:
    w = M.bk_weights(6, 32, 12)
    terms = " + ".join([f"y * {w[0]!r}"] + [f"(lag(y, {j}) OVER w + lead(y, {j}) OVER w) * {w[j]!r}" for j in range(1, 13)])
    return f"SELECT * FROM (SELECT t, round({terms}, 6) + 0.0 AS cycle FROM ({S.MONTHLY}) WINDOW w AS (ORDER BY t)) WHERE cycle IS NOT NULL"


@query("bk_filter", _bk_sql())
def bk_filter(spark, d):
    return rounded(M.bk_filter(S.monthly(spark, d), "y", "t"))


@query("hamilton_random_walk", f"SELECT * FROM (SELECT t, round(y - lag(y, 8) OVER (ORDER BY t), 8) + 0.0 AS cycle FROM ({S.MONTHLY})) WHERE cycle IS NOT NULL")
def hamilton_random_walk(spark, d):
    return rounded(M.hamilton_random_walk(S.monthly(spark, d), "y", "t"), 8)


def _frac_sql(order: float) -> str:
    return (
        f"WITH RECURSIVE w(k, pi) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, pi * (k - ({order!r})) / (k + 1) FROM w WHERE k < 200), "
        f"s AS (SELECT t, y, row_number() OVER (ORDER BY t) AS rn FROM ({S.MONTHLY})) "
        "SELECT a.t, round(sum(w.pi * b.y), 6) + 0.0 AS value FROM s a JOIN s b ON b.rn <= a.rn JOIN w ON w.k = a.rn - b.rn GROUP BY 1"
    )


@query("frac_diff", _frac_sql(0.4))
def frac_diff(spark, d):
    return rounded(M.frac_diff(S.monthly(spark, d), "y", "t", d=0.4))


@query("frac_integrate", _frac_sql(-0.4))
def frac_integrate(spark, d):
    return rounded(M.frac_integrate(S.monthly(spark, d), "y", "t", d=0.4))


_REALIZED = (
    f"b AS (SELECT m, abs(r) AS a, lag(abs(r), 1) OVER (PARTITION BY m ORDER BY t) AS a1, lag(abs(r), 2) OVER (PARTITION BY m ORDER BY t) AS a2 FROM ({S.RETURNS})), "
    f"q AS (SELECT m, count(a) AS n, sum(a * a) AS rv, coalesce(sum(a * a1), 0) * {math.pi / 2!r} AS bv, count(a) / 3.0 * sum(pow(a, 4.0)) AS rq, count(a) * {M.MU43**-3!r} * coalesce(sum(pow(a, {4 / 3!r}) * pow(a1, {4 / 3!r}) * pow(a2, {4 / 3!r})), 0) AS tq FROM b GROUP BY 1)"
)


@query("realized_measures", f"WITH {_REALIZED} SELECT m, n, round(rv, 6) + 0.0 AS rv, round(bv, 6) + 0.0 AS bipower, round(greatest(rv - bv, 0), 6) + 0.0 AS jump FROM q")
def realized_measures(spark, d):
    return rounded(M.realized_measures(S.returns(spark, d), "r", "t", ["m"]).select("m", "n", "rv", "bipower", "jump"))


@query("realized_quarticity", f"WITH {_REALIZED} SELECT m, round(rq, 6) + 0.0 AS rq FROM q")
def realized_quarticity(spark, d):
    return rounded(M.realized_measures(S.returns(spark, d), "r", "t", ["m"]).select("m", "rq"))


@query("tripower_quarticity", f"WITH {_REALIZED} SELECT m, round(tq, 6) + 0.0 AS tq FROM q")
def tripower_quarticity(spark, d):
    return rounded(M.realized_measures(S.returns(spark, d), "r", "t", ["m"]).select("m", "tq"))


@query(
    "bns_jump_test",
    f"WITH {_REALIZED} SELECT m, CASE WHEN rv > 0 AND bv > 0 THEN round(sqrt(n) * (rv - bv) / rv / sqrt({math.pi**2 / 4 + math.pi - 5!r} * greatest(1.0, tq / bv / bv)), 6) + 0.0 END AS bns_ratio FROM q",
)
def bns_jump_test(spark, d):
    return rounded(M.realized_measures(S.returns(spark, d), "r", "t", ["m"]).select("m", "bns_ratio"))


@query("realized_range", f"SELECT g, round(sum(pow(ln((high + 300) / (low + 300)), 2)) / {4 * math.log(2)!r}, 6) + 0.0 AS value FROM ({S.BARS}) GROUP BY 1")
def realized_range(spark, d):
    return rounded(M.realized_range(_shifted(S.bars(spark, d)), "high", "low", ["g"]))


@query(
    "realized_range_gk",
    f"SELECT g, round(sum(0.5 * pow(ln((high + 300) / (low + 300)), 2) - {2 * math.log(2) - 1!r} * pow(ln((\"close\" + 300) / (open + 300)), 2)), 6) + 0.0 AS value FROM ({S.BARS}) GROUP BY 1",
)
def realized_range_gk(spark, d):
    return rounded(M.realized_range(_shifted(S.bars(spark, d)), "high", "low", ["g"], "garman_klass", "open", "close"))


def _shifted(bars):
    return bars.withColumns({c: F.col(c) + 300 for c in ("high", "low", "open", "close")})


@query(
    "pseudo_obs",
    f"SELECT g, t, round((rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0) / (count(*) OVER (PARTITION BY g) + 1), 6) + 0.0 AS u_y, "
    f"round((rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0) / (count(*) OVER (PARTITION BY g) + 1), 6) + 0.0 AS u_x FROM ({S.TYPE_DAYS})",
)
def pseudo_obs(spark, d):
    return rounded(M.pseudo_obs(S.type_days(spark, d), ["y", "x"], ["g"]).select("g", "t", "u_y", "u_x"))


_NAIVE = f"SELECT g, t, y, lag(y) OVER (PARTITION BY g ORDER BY t) AS f1, avg(y) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f2 FROM ({S.TYPE_DAYS})"


def _naive(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("t")
    return S.type_days(spark, d).select("g", "t", "y", F.lag("y").over(w).alias("f1"), F.avg("y").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("f2")).where("f1 IS NOT NULL")


@query(
    "accuracy",
    f"SELECT g, count(*) AS n, round(avg(y - f1), 6) + 0.0 AS me, round(sqrt(avg(pow(y - f1, 2))), 6) + 0.0 AS rmse, round(avg(abs(y - f1)), 6) + 0.0 AS mae, round(avg(100 * abs((y - f1) / y)), 6) + 0.0 AS mape, "
    f"round(avg(200 * abs(y - f1) / (abs(y) + abs(f1))), 6) + 0.0 AS smape, round(quantile_cont(abs(y - f1), 0.5), 6) + 0.0 AS mdae FROM ({_NAIVE}) WHERE f1 IS NOT NULL GROUP BY 1",
)
def accuracy(spark, d):
    return rounded(M.accuracy(_naive(spark, d), "y", "f1", ["g"]))


@query(
    "accuracy_scales",
    f"SELECT g, round(avg(abs(e)), 6) + 0.0 AS abs_scale, round(sqrt(avg(e * e)), 6) + 0.0 AS sq_scale FROM (SELECT g, y - lag(y, 7) OVER (PARTITION BY g ORDER BY t) AS e FROM ({S.TYPE_DAYS})) WHERE e IS NOT NULL GROUP BY 1",
)
def accuracy_scales(spark, d):
    return rounded(M.seasonal_scales(S.type_days(spark, d), "y", "t", ["g"], 7))


_LOSSES = f"SELECT g, t, y - f1 AS e1, y - f2 AS e2, f1, f2 FROM ({_NAIVE}) WHERE f1 IS NOT NULL"


def _mean_test_sql(difference: str, lags: int, out: str, uniform: bool = False) -> str:
    weight = "1 / (n - lag)" if uniform else f"(1 - lag / {lags + 1}.0) / n"
    return (
        f"WITH x AS (SELECT g, t, {difference} AS d0 FROM ({_LOSSES})), s AS (SELECT g, d0, avg(d0) OVER (PARTITION BY g) AS mu, d0 - avg(d0) OVER (PARTITION BY g) AS d, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY t) AS rn FROM x), "
        f"k AS (SELECT unnest(range(0, {lags + 1})) AS lag), c AS (SELECT a.g, any_value(a.n)::DOUBLE AS n, any_value(a.mu) AS mu, k.lag, sum(a.d * b.d) AS v FROM k, s a JOIN s b ON a.g = b.g WHERE b.rn = a.rn - k.lag GROUP BY a.g, k.lag), "
        f"l AS (SELECT g, any_value(n) AS n, any_value(mu) AS mu, sum(CASE WHEN lag = 0 THEN 1 ELSE 2 END * {weight} * v) AS lrv FROM c GROUP BY 1) SELECT g, {out} FROM l"
    )


@query(
    "dm_test_stat",
    _mean_test_sql("e1 * e1 - e2 * e2", 1, "round(mu / sqrt(lrv / n), 6) + 0.0 AS dm_stat, round(mu / sqrt(lrv / n) * sqrt((n + 1 - 4 + 2 / n) / n), 6) + 0.0 AS hln_stat, round(mu, 6) + 0.0 AS mean_loss_diff", uniform=True),
)
def dm_test_stat(spark, d):
    e = _naive(spark, d).withColumns({"e1": F.col("y") - F.col("f1"), "e2": F.col("y") - F.col("f2")})
    return rounded(M.dm_test(e, "e1", "e2", "t", ["g"], h=2).drop("p_value"))


@query(
    "dm_test",
    _mean_test_sql(
        "e1 * e1 - e2 * e2",
        0,
        "round(mu / sqrt(lrv / n), 6) + 0.0 AS dm_stat, round(mu / sqrt(lrv / n) * sqrt((n - 1) / n), 6) + 0.0 AS hln_stat, "
        f"round({Q.t_two_sided('(mu / sqrt(lrv / n) * sqrt((n - 1) / n))', '(n - 1)')}, 6) + 0.0 AS p_value, round(mu, 6) + 0.0 AS mean_loss_diff",
        uniform=True,
    ),
)
def dm_test(spark, d):
    e = _naive(spark, d).withColumns({"e1": F.col("y") - F.col("f1"), "e2": F.col("y") - F.col("f2")})
    return rounded(M.dm_test(e, "e1", "e2", "t", ["g"]))


@query(
    "cw_test_stat",
    _mean_test_sql("e2 * e2 - e1 * e1 + (f2 - f1) * (f2 - f1)", 2, "round(mu / sqrt(lrv / n), 6) + 0.0 AS cw_stat, round(mu, 6) + 0.0 AS mean_adj_diff"),
)
def cw_test_stat(spark, d):
    e = _naive(spark, d).withColumns({"e1": F.col("y") - F.col("f1"), "e2": F.col("y") - F.col("f2")})
    return rounded(M.cw_test(e, "e2", "e1", "f2", "f1", "t", ["g"], lrv_lags=2).drop("p_value"))


@query(
    "cw_test",
    _mean_test_sql("e2 * e2 - e1 * e1 + (f2 - f1) * (f2 - f1)", 0, f"round(mu / sqrt(lrv / n), 6) + 0.0 AS cw_stat, round({Q.norm_sf('(mu / sqrt(lrv / n))')}, 6) + 0.0 AS p_value, round(mu, 6) + 0.0 AS mean_adj_diff"),
)
def cw_test(spark, d):
    e = _naive(spark, d).withColumns({"e1": F.col("y") - F.col("f1"), "e2": F.col("y") - F.col("f2")})
    return rounded(M.cw_test(e, "e2", "e1", "f2", "f1", "t", ["g"]))


@query("gw_test_stat", _mean_test_sql("abs(e1) - abs(e2)", 2, "round(n * mu * mu / lrv, 6) + 0.0 AS gw_stat, 1::INTEGER AS df"))
def gw_test_stat(spark, d):
    e = _naive(spark, d).withColumns({"l1": F.abs(F.col("y") - F.col("f1")), "l2": F.abs(F.col("y") - F.col("f2"))})
    return rounded(M.gw_test(e, "l1", "l2", "t", ["g"], lrv_lags=2).drop("p_value"))


@query("gw_test", _mean_test_sql("abs(e1) - abs(e2)", 0, f"round(n * mu * mu / lrv, 6) + 0.0 AS gw_stat, round({Q.chi2_sf('(n * mu * mu / lrv)', '1')}, 6) + 0.0 AS p_value, 1::INTEGER AS df"))
def gw_test(spark, d):
    e = _naive(spark, d).withColumns({"l1": F.abs(F.col("y") - F.col("f1")), "l2": F.abs(F.col("y") - F.col("f2"))})
    return rounded(M.gw_test(e, "l1", "l2", "t", ["g"]))


_ORIGIN = f"s AS (SELECT y, row_number() OVER (ORDER BY t) AS rn, avg(y) OVER (ORDER BY t) AS mean, first(y) OVER (ORDER BY t) AS head FROM ({S.MONTHLY})), h AS (SELECT unnest(range(1, 4)) AS h)"


def _backtest_sql(forecast: str, extra: str = "") -> str:
    return f"WITH {_ORIGIN} SELECT CAST(o.rn AS INTEGER) AS origin, CAST(h.h AS INTEGER) AS h, round({forecast}, 8) + 0.0 AS forecast, round(a.y, 8) + 0.0 AS actual FROM s o, h JOIN s a ON a.rn = o.rn + h.h {extra} WHERE o.rn >= 24"


@query("backtest", _backtest_sql("o.y"))
def backtest(spark, d):
    return rounded(M.backtest(S.monthly(spark, d), "y", "t", train=24, horizon=3), 8)


@query("backtest_mean", _backtest_sql("o.mean"))
def backtest_mean(spark, d):
    return rounded(M.backtest(S.monthly(spark, d), "y", "t", train=24, horizon=3, forecaster="mean"), 8)


@query("backtest_drift", _backtest_sql("o.y + h.h * (o.y - o.head) / (o.rn - 1)"))
def backtest_drift(spark, d):
    return rounded(M.backtest(S.monthly(spark, d), "y", "t", train=24, horizon=3, forecaster="drift"), 8)


@query("backtest_seasonal", _backtest_sql("p.y", "JOIN s p ON p.rn = o.rn - 12 + h.h"))
def backtest_seasonal(spark, d):
    return rounded(M.backtest(S.monthly(spark, d), "y", "t", train=24, horizon=3, forecaster="seasonal_naive", period=12), 8)


@query(
    "cv_splits",
    "WITH f AS (SELECT unnest(range(0, 6)) AS f), c AS (SELECT f, 20 + 5 * f AS cut FROM f) "
    "SELECT CAST(f AS INTEGER) AS fold, 'train' AS part, CAST(unnest(range(0, cut)) AS INTEGER) AS \"row\" FROM c UNION ALL SELECT CAST(f AS INTEGER), 'test', CAST(unnest(range(cut, cut + 4)) AS INTEGER) FROM c",
)
def cv_splits(spark, d):
    return M.cv_splits(spark, 50, "expanding", train=20, horizon=4, step=5)


@query(
    "cv_splits_purged",
    "WITH f AS (SELECT unnest(range(0, 4)) AS f), c AS (SELECT f, f * 12 + least(f, 2) AS a, (f + 1) * 12 + least(f + 1, 2) AS b FROM f), r AS (SELECT f, a, b, unnest(range(0, 50)) AS i FROM c) "
    "SELECT CAST(f AS INTEGER) AS fold, CASE WHEN i >= a AND i < b THEN 'test' ELSE 'train' END AS part, CAST(i AS INTEGER) AS \"row\" FROM r WHERE (i >= a AND i < b) OR i < a - 2 OR i >= b + 3",
)
def cv_splits_purged(spark, d):
    return M.cv_splits(spark, 50, "purged_kfold", k=4, purge=2, embargo=3)


@query(
    "forecast_disagreement",
    f"SELECT t, round(stddev_samp(y), 6) + 0.0 AS std, round(quantile_cont(y, 0.25), 6) + 0.0 AS p25, round(quantile_cont(y, 0.5), 6) + 0.0 AS p50, round(quantile_cont(y, 0.75), 6) + 0.0 AS p75, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 6) + 0.0 AS iqr, count(*) AS n FROM ({S.TYPE_DAYS}) GROUP BY 1",
)
def forecast_disagreement(spark, d):
    return rounded(M.forecast_disagreement(S.type_days(spark, d), "y", "t"))


@query(
    "midas_weights",
    "WITH w AS (SELECT j, exp(0.1 * j - 0.05 * j * j) AS raw FROM (SELECT unnest(range(1, 13)) AS j)) SELECT CAST(j AS INTEGER) AS j, round(raw / sum(raw) OVER (), 6) + 0.0 AS weight FROM w",
)
def midas_weights(spark, d):
    return rounded(M.midas_weights(spark))


@query(
    "block_maxima",
    f"SELECT CAST(b AS INTEGER) AS block, round(max(r), 6) + 0.0 AS maximum FROM (SELECT r, (row_number() OVER (ORDER BY t) - 1) // 30 AS b FROM ({S.RETURNS})) GROUP BY b HAVING count(*) = 30",
)
def block_maxima(spark, d):
    return rounded(M.block_maxima(S.returns(spark, d), "r", "t", block_size=30))


@query(
    "var_backtest_stat",
    f"WITH b AS (SELECT hit AS h, lag(hit) OVER (ORDER BY t) AS p FROM (SELECT t, CASE WHEN r < -0.6 THEN 1 ELSE 0 END AS hit FROM ({S.RETURNS}))) "
    "SELECT count(*) AS n, CAST(sum(h) AS BIGINT) AS n_violations, count(*) FILTER (WHERE p = 0 AND h = 0) AS n00, count(*) FILTER (WHERE p = 0 AND h = 1) AS n01, count(*) FILTER (WHERE p = 1 AND h = 0) AS n10, count(*) FILTER (WHERE p = 1 AND h = 1) AS n11, round(avg(h), 6) + 0.0 AS hit_rate FROM b",
)
def var_backtest_stat(spark, d):
    hits = S.returns(spark, d).select("t", (F.col("r") < -0.6).cast("int").alias("hit"))
    return rounded(M.var_backtest_counts(hits, "hit", "t").select("n", "n_violations", "n00", "n01", "n10", "n11", "hit_rate"))
