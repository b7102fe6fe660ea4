"""Operators that are windows and aggregates: Spark plans all of them.

Every function takes a table, the names of its order column, its values and (where there are many series) its key columns, and gives a table.
Windows are partitioned by the key; a single series without a key is one partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special


def _ordered(key: Sequence[str], time: str):
    return Window.partitionBy(*key).orderBy(time) if key else Window.orderBy(time)


def _over(key: Sequence[str]):
    return Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))


def _lag_products(df: DataFrame, y: str, time: str, key: Sequence[str], lags: int, demean: bool = True) -> DataFrame:
    """(key…, n, c): sums of products at lags 0..lags, after removing the mean."""
    d = F.col(y).cast("double") - (F.avg(y).over(_over(key)) if demean else F.lit(0.0))
    base = df.select(*key, F.col(time).alias("_t"), d.alias("_d"))
    base = base.withColumns({f"_l{k}": F.lag("_d", k).over(_ordered(key, "_t")) for k in range(1, lags + 1)})
    sums = [F.sum(F.col("_d") * F.col("_d"))] + [F.coalesce(F.sum(F.col("_d") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, lags + 1)]
    return base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("c"))


def acf(df: DataFrame, y: str, time: str, key: Sequence[str] = (), nlags: int = 20, adjusted: bool = False) -> DataFrame:
    """(key…, lag, acf, bartlett_se)."""
    c = _lag_products(df, y, time, key, nlags)
    r = c.select(*key, "n", F.posexplode("c").alias("lag", "v"), F.element_at("c", 1).alias("c0"))
    scale = F.col("n") / (F.col("n") - F.col("lag")) if adjusted else F.lit(1.0)
    r = r.withColumn("acf", F.col("v") / F.col("c0") * scale)
    before = (_ordered(key, "lag")).rowsBetween(Window.unboundedPreceding, -1)
    squares = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf")).otherwise(0.0)).over(before)
    se = F.when(F.col("lag") == 0, 0.0).otherwise(F.sqrt((1 + 2 * F.coalesce(squares, F.lit(0.0))) / F.col("n")))
    return r.select(*key, F.col("lag").cast("int").alias("lag"), "acf", se.alias("bartlett_se"))


def ljung_box(df: DataFrame, y: str, time: str, key: Sequence[str] = (), nlags: int = 10) -> DataFrame:
    """(key…, lag, lb_stat, lb_pvalue, bp_stat, bp_pvalue) for each number of lags up to ``nlags``."""
    c = _lag_products(df, y, time, key, nlags)
    r = c.select(*key, "n", F.posexplode("c").alias("lag", "v"), F.element_at("c", 1).alias("c0")).where("lag > 0")
    w = _ordered(key, "lag").rowsBetween(Window.unboundedPreceding, 0)
    sq = F.pow(F.col("v") / F.col("c0"), 2)
    out = r.select(
        *key,
        F.col("lag").cast("int").alias("lag"),
        (F.col("n") * (F.col("n") + 2) * F.sum(sq / (F.col("n") - F.col("lag"))).over(w)).alias("lb_stat"),
        (F.col("n") * F.sum(sq).over(w)).alias("bp_stat"),
    )
    return out.select(
        *key, "lag", "lb_stat", special.column(special.chi2_sf, "lb_stat", "lag").alias("lb_pvalue"), "bp_stat", special.column(special.chi2_sf, "bp_stat", "lag").alias("bp_pvalue")
    )


def jarque_bera(df: DataFrame, y: str, key: Sequence[str] = ()) -> DataFrame:
    """(key…, statistic, p_value, skewness, kurtosis, n); kurtosis is not in excess of 3."""
    m = df.groupBy(*key).agg(F.count(y).alias("n"), F.skewness(y).alias("skewness"), (F.kurtosis(y) + 3).alias("kurtosis"))
    jb = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow(F.col("kurtosis") - 3, 2) / 4)
    return m.select(*key, jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"), "skewness", "kurtosis", "n")


def default_bandwidth(n: Column) -> Column:
    """floor(4 (n / 100)^(2/9))."""
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))


def lag_weight(kernel: str, j: Column, bandwidth: Column | float) -> Column:
    b = bandwidth if isinstance(bandwidth, Column) else F.lit(float(bandwidth))
    if kernel == "bartlett":
        return F.greatest(1 - j / (b + 1), F.lit(0.0))
    if kernel == "truncated":
        return (j <= b).cast("double")
    if kernel == "parzen":
        z = j / (b + 1)
        return F.when(z <= 0.5, 1 - 6 * z * z + 6 * z * z * z).when(z <= 1, 2 * F.pow(1 - z, 3)).otherwise(0.0)
    raise ValueError(f"kernel {kernel!r}: bartlett, parzen or truncated; the quadratic spectral one has no last lag and is a grouped kernel")


def long_run_variance(df: DataFrame, y: str, time: str, key: Sequence[str] = (), kernel: str = "bartlett", bandwidth: float | None = None) -> DataFrame:
    """(key…, lrv, bandwidth): of the demeaned series, with autocovariances over n. Without a bandwidth, rows are counted first, for the lags that the longest series needs."""
    if bandwidth is None:
        longest = df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
        lags = math.floor(4 * (longest / 100) ** (2 / 9))
    else:
        lags = int(bandwidth)
    c = _lag_products(df, y, time, key, lags)
    b = F.lit(float(bandwidth)) if bandwidth is not None else default_bandwidth(F.col("n"))
    r = c.select(*key, "n", b.cast("double").alias("b"), F.posexplode("c").alias("lag", "v"))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * lag_weight(kernel, F.col("lag").cast("double"), F.col("b")))
    return r.groupBy(*key).agg(F.sum(weight * F.col("v") / F.col("n")).alias("lrv"), F.first("b").alias("bandwidth"))


def bk_weights(low: float, high: float, k: int) -> list[float]:
    """Of the ideal band-pass filter between two periods, cut at ``k`` and made to sum to zero; index 0 is the centre."""
    a, b = 2 * math.pi / high, 2 * math.pi / low
    w = [(b - a) / math.pi] + [(math.sin(b * j) - math.sin(a * j)) / (math.pi * j) for j in range(1, k + 1)]
    excess = (w[0] + 2 * sum(w[1:])) / (2 * k + 1)
    return [x - excess for x in w]


def bk_filter(df: DataFrame, y: str, time: str, key: Sequence[str] = (), low: float = 6.0, high: float = 32.0, k: int = 12) -> DataFrame:
    """(key…, time, cycle); the first and last ``k`` rows have none and are left out."""
    w = _ordered(key, time)
    b = bk_weights(low, high, k)
    terms = F.col(y) * b[0]
    for j in range(1, k + 1):
        terms = terms + (F.lag(y, j).over(w) + F.lead(y, j).over(w)) * b[j]
    return df.select(*key, time, terms.alias("cycle")).where("cycle IS NOT NULL")


def hamilton_random_walk(df: DataFrame, y: str, time: str, key: Sequence[str] = (), h: int = 8) -> DataFrame:
    """(key…, time, cycle): y less y ``h`` rows before."""
    return df.select(*key, time, (F.col(y) - F.lag(y, h).over(_ordered(key, time))).alias("cycle")).where("cycle IS NOT NULL")


def frac_diff(df: DataFrame, y: str, time: str, key: Sequence[str] = (), d: float = 0.4) -> DataFrame:
    """(key…, time, value): the fractional difference, cut at the start of the sample."""
    w = _ordered(key, time)
    seen = df.select(*key, time, F.collect_list(F.col(y).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("past"))
    start = F.struct(F.lit(1.0).alias("pi"), F.lit(0.0).alias("total"), F.lit(0).alias("k"))

    def step(acc, value):
        pi = F.when(acc["k"] == 0, 1.0).otherwise(acc["pi"] * (acc["k"] - 1 - d) / F.greatest(acc["k"], F.lit(1)))
        return F.struct(pi.alias("pi"), (acc["total"] + pi * value).alias("total"), (acc["k"] + 1).alias("k"))

    return seen.select(*key, time, F.aggregate(F.reverse("past"), start, step, lambda acc: acc["total"]).alias("value"))


def frac_integrate(df: DataFrame, y: str, time: str, key: Sequence[str] = (), d: float = 0.4) -> DataFrame:
    """The inverse of ``frac_diff``."""
    return frac_diff(df, y, time, key, -d)


MU43 = 2 ** (2 / 3) * math.gamma(7 / 6) / math.gamma(1 / 2)


def realized_measures(df: DataFrame, r: str, time: str, key: Sequence[str] = ()) -> DataFrame:
    """(key…, n, rv, bipower, jump, rq, tq, bns_ratio) of the returns of each key."""
    w = _ordered(key, time)
    a = F.abs(F.col(r).cast("double"))
    base = df.select(*key, a.alias("a"), F.lag(a, 1).over(w).alias("a1"), F.lag(a, 2).over(w).alias("a2"))
    p = 4 / 3
    sums = base.groupBy(*key).agg(
        F.count("a").alias("n"),
        F.sum(F.col("a") * F.col("a")).alias("rv"),
        (F.coalesce(F.sum(F.col("a") * F.col("a1")), F.lit(0.0)) * (math.pi / 2)).alias("bipower"),
        (F.count("a") / 3 * F.sum(F.pow("a", F.lit(4.0)))).alias("rq"),
        (F.count("a") * MU43**-3 * F.coalesce(F.sum(F.pow("a", F.lit(p)) * F.pow("a1", F.lit(p)) * F.pow("a2", F.lit(p))), F.lit(0.0))).alias("tq"),
    )
    theta = math.pi**2 / 4 + math.pi - 5
    ratio = F.sqrt("n") * (F.col("rv") - F.col("bipower")) / F.col("rv") / F.sqrt(theta * F.greatest(F.lit(1.0), F.col("tq") / F.col("bipower") / F.col("bipower")))
    return sums.select(*key, "n", "rv", "bipower", F.greatest(F.col("rv") - F.col("bipower"), F.lit(0.0)).alias("jump"), "rq", "tq", F.when((F.col("rv") > 0) & (F.col("bipower") > 0), ratio).alias("bns_ratio"))


def realized_range(df: DataFrame, high: str, low: str, key: Sequence[str] = (), method: str = "parkinson", open: str | None = None, close: str | None = None) -> DataFrame:
    """(key…, value): Parkinson or Garman-Klass variance of bars; prices must be positive."""
    hl = F.pow(F.log(F.col(high) / F.col(low)), 2)
    if method == "parkinson":
        return df.groupBy(*key).agg((F.sum(hl) / (4 * math.log(2))).alias("value"))
    if method != "garman_klass" or open is None or close is None:
        raise ValueError("method is parkinson, or garman_klass with open and close")
    return df.groupBy(*key).agg(F.sum(0.5 * hl - (2 * math.log(2) - 1) * F.pow(F.log(F.col(close) / F.col(open)), 2)).alias("value"))


def pseudo_obs(df: DataFrame, columns: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """``df`` with u_<column>: average rank / (n + 1)."""
    n = F.count(F.lit(1)).over(_over(key))
    out = df
    for c in columns:
        ties = F.count(F.lit(1)).over(Window.partitionBy(*key, c))
        rank = F.rank().over(_ordered(key, c)) + (ties - 1) / 2
        out = out.withColumn(f"u_{c}", rank / (n + 1))
    return out


def accuracy(df: DataFrame, actual: str, forecast: str, key: Sequence[str] = (), scale: Column | None = None) -> DataFrame:
    """(key…, n, me, rmse, mae, mape, smape, mdae); a zero actual gives a null mape, a zero denominator a null smape."""
    e = F.col(actual) - F.col(forecast)
    zero = F.max((F.col(actual) == 0).cast("int"))
    none = F.max((F.abs(F.col(actual)) + F.abs(F.col(forecast)) == 0).cast("int"))
    size = F.nullif(F.abs(F.col(actual)) + F.abs(F.col(forecast)), F.lit(0.0))
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(e).alias("me"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(zero == 0, F.avg(100 * F.abs(e / F.nullif(F.col(actual), F.lit(0.0))))).alias("mape"),
        F.when(none == 0, F.avg(200 * F.abs(e) / size)).alias("smape"),
        F.percentile(F.abs(e), F.lit(0.5)).alias("mdae"),
    )


def seasonal_scales(df: DataFrame, y: str, time: str, key: Sequence[str] = (), period: int = 1) -> DataFrame:
    """(key…, abs_scale, sq_scale): mean absolute and root mean squared seasonal-naive errors in sample, for mase and rmsse."""
    d = df.select(*key, (F.col(y) - F.lag(y, period).over(_ordered(key, time))).alias("d")).where("d IS NOT NULL")
    return d.groupBy(*key).agg(F.avg(F.abs("d")).alias("abs_scale"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("sq_scale"))


def dm_test(df: DataFrame, e1: str, e2: str, time: str, key: Sequence[str] = (), h: int = 1, loss=None) -> DataFrame:
    """(key…, dm_stat, hln_stat, p_value, mean_loss_diff); ``loss`` maps an error column to its loss (squared by default)."""
    loss = loss or (lambda e: e * e)
    base = df.select(*key, F.col(time).alias("_t"), (loss(F.col(e1)) - loss(F.col(e2))).alias("d"))
    c = _lag_products(base, "d", "_t", key, h - 1).join(base.groupBy(*key).agg(F.avg("d").alias("mean")), list(key)) if key else _lag_products(base, "d", "_t", key, h - 1).withColumn("_k", F.lit(0)).join(base.agg(F.avg("d").alias("mean")).withColumn("_k", F.lit(0)), "_k").drop("_k")
    lrv = F.aggregate(F.transform("c", lambda v, k: F.when(k == 0, 1.0).otherwise(2.0) * v / (F.col("n") - k)), F.lit(0.0), lambda a, v: a + v)
    n = F.col("n")
    stat = c.withColumn("dm_stat", F.col("mean") / F.sqrt(lrv / n)).withColumn("hln_stat", F.col("dm_stat") * F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))
    return stat.select(*key, "dm_stat", "hln_stat", special.column(special.t_two_sided, "hln_stat", n - 1).alias("p_value"), F.col("mean").alias("mean_loss_diff"))


def _mean_and_lrv(df: DataFrame, d: Column, time: str, key: Sequence[str], lags: int) -> DataFrame:
    base = df.select(*key, F.col(time).alias("_t"), d.alias("d"))
    w = _over(key)
    base = base.withColumn("_mean", F.avg("d").over(w))
    c = _lag_products(base, "d", "_t", key, lags)
    m = base.groupBy(*key).agg(F.first("_mean").alias("mean"))
    both = c.join(m, list(key)) if key else c.withColumn("_k", F.lit(0)).join(m.withColumn("_k", F.lit(0)), "_k").drop("_k")
    weight = lambda k: F.when(k == 0, 1.0).otherwise(2 * (1 - k / (lags + 1)))
    return both.withColumn("lrv", F.aggregate(F.transform("c", lambda v, k: weight(k) * v / F.col("n")), F.lit(0.0), lambda a, v: a + v))


def cw_test(df: DataFrame, e_small: str, e_large: str, f_small: str, f_large: str, time: str, key: Sequence[str] = (), lrv_lags: int = 0) -> DataFrame:
    """(key…, cw_stat, p_value, mean_adj_diff): nested models, one-sided."""
    d = F.pow(e_small, F.lit(2)) - F.pow(e_large, F.lit(2)) + F.pow(F.col(f_small) - F.col(f_large), 2)
    m = _mean_and_lrv(df, d, time, key, lrv_lags).withColumn("cw_stat", F.col("mean") / F.sqrt(F.col("lrv") / F.col("n")))
    return m.select(*key, "cw_stat", special.column(special.norm_sf, "cw_stat").alias("p_value"), F.col("mean").alias("mean_adj_diff"))


def gw_test(df: DataFrame, loss1: str, loss2: str, time: str, key: Sequence[str] = (), lrv_lags: int = 0) -> DataFrame:
    """(key…, gw_stat, p_value, df): unconditional predictive ability."""
    m = _mean_and_lrv(df, F.col(loss1) - F.col(loss2), time, key, lrv_lags).withColumn("gw_stat", F.col("n") * F.pow("mean", F.lit(2)) / F.col("lrv"))
    return m.select(*key, "gw_stat", special.column(special.chi2_sf, "gw_stat", F.lit(1.0)).alias("p_value"), F.lit(1).alias("df"))


def backtest(df: DataFrame, y: str, time: str, key: Sequence[str] = (), train: int = 20, horizon: int = 1, step: int = 1, forecaster: str = "naive", period: int = 1, window: str = "expanding") -> DataFrame:
    """(key…, origin, h, forecast, actual): forecasts from each origin (rows seen so far) for the next ``horizon`` rows.

    Forecasts are window expressions at the origin's row; only the targets are joined to them."""
    w = _ordered(key, time)
    past = w.rowsBetween(Window.unboundedPreceding if window == "expanding" else -(train - 1), 0)
    base = df.select(*key, F.col(y).cast("double").alias("y"), F.row_number().over(w).alias("rn"), F.avg(y).over(past).alias("mean"), F.first(y).over(past).alias("head"), F.count(F.lit(1)).over(past).alias("seen"))
    recent = {j: F.lag("y", j) for j in range(period)}
    order = _ordered(key, "rn")
    base = base.withColumn("recent", F.array(*(recent[period - 1 - j].over(order) for j in range(period))))
    h = F.col("h")
    guess = {
        "naive": F.col("y"),
        "mean": F.col("mean"),
        "drift": F.col("y") + h * (F.col("y") - F.col("head")) / F.greatest(F.col("seen") - 1, F.lit(1)),
        "seasonal_naive": F.element_at("recent", F.pmod(h - 1, F.lit(period)) + 1),
    }
    if forecaster not in guess:
        raise ValueError(f"forecaster {forecaster!r}: {', '.join(guess)}")
    origins = base.where((F.col("rn") >= train) & ((F.col("rn") - train) % step == 0))
    made = origins.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(*key, F.col("rn").alias("origin"), "h", guess[forecaster].alias("forecast"), (F.col("rn") + h).alias("rn"))
    return made.join(base.select(*key, "rn", F.col("y").alias("actual")), [*key, "rn"]).select(*key, "origin", "h", "forecast", "actual")


def cv_splits(spark, n: int, scheme: str = "expanding", train: int = 0, horizon: int = 1, step: int = 1, k: int = 5, purge: int = 0, embargo: int = 0) -> DataFrame:
    """(fold, part, row): rows (from 0) of the training and test parts of each fold."""
    if scheme in ("expanding", "rolling"):
        folds = spark.range(max(0, (n - horizon - train) // step + 1)).select(F.col("id").cast("int").alias("fold"), (F.lit(train) + F.col("id") * step).cast("int").alias("cut"))
        first = F.lit(0) if scheme == "expanding" else F.col("cut") - train
        fit = folds.select("fold", F.lit("train").alias("part"), F.explode(F.sequence(first.cast("int"), F.col("cut") - 1)).alias("row"))
        test = folds.select("fold", F.lit("test").alias("part"), F.explode(F.sequence(F.col("cut"), F.col("cut") + horizon - 1)).alias("row"))
        return fit.union(test)
    if scheme != "purged_kfold":
        raise ValueError(f"scheme {scheme!r}: expanding, rolling or purged_kfold")
    base, more = divmod(n, k)
    folds = spark.range(k).select(
        F.col("id").cast("int").alias("fold"),
        (F.col("id") * base + F.least(F.col("id"), F.lit(more))).cast("int").alias("a"),
        ((F.col("id") + 1) * base + F.least(F.col("id") + 1, F.lit(more))).cast("int").alias("b"),
    )
    rows = folds.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    test = (F.col("row") >= F.col("a")) & (F.col("row") < F.col("b"))
    away = (F.col("row") < F.col("a") - purge) | (F.col("row") >= F.col("b") + max(purge, embargo))
    return rows.where(test | away).select("fold", F.when(test, "test").otherwise("train").alias("part"), "row")


def forecast_disagreement(df: DataFrame, value: str, period: str) -> DataFrame:
    """(period, std, p25, p50, p75, iqr, n) over forecasters."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    m = df.groupBy(period).agg(F.stddev_samp(value).alias("std"), q.alias("q"), F.count(value).alias("n"))
    at = lambda i: F.element_at("q", i)
    return m.select(period, "std", at(1).alias("p25"), at(2).alias("p50"), at(3).alias("p75"), (at(3) - at(1)).alias("iqr"), "n")


def midas_weights(spark, scheme: str = "exp_almon", theta1: float = 0.1, theta2: float = -0.05, k: int = 12) -> DataFrame:
    """(j, weight): exponential Almon or Beta lag weights that sum to one."""
    j = F.col("j").cast("double")
    if scheme == "exp_almon":
        raw = F.exp(theta1 * j + theta2 * j * j)
        rows = spark.range(1, k + 1)
    elif scheme == "beta":
        u = F.least(F.greatest((j - 1) / max(k - 1, 1), F.lit(2.0**-52)), F.lit(1 - 2.0**-52))
        raw = F.pow(u, F.lit(theta1 - 1)) * F.pow(1 - u, F.lit(theta2 - 1))
        rows = spark.range(1, k + 1)
    else:
        raise ValueError(f"scheme {scheme!r}: exp_almon or beta")
    rows = rows.select(F.col("id").cast("int").alias("j")).withColumn("raw", raw)
    return rows.select("j", (F.col("raw") / F.sum("raw").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def block_maxima(df: DataFrame, y: str, time: str, key: Sequence[str] = (), block_size: int = 30) -> DataFrame:
    """(key…, block, maximum) of whole blocks of consecutive rows."""
    rn = df.select(*key, F.col(y).alias("y"), (F.row_number().over(_ordered(key, time)) - 1).alias("rn"))
    block = F.floor(F.col("rn") / block_size)
    return rn.groupBy(*key, block.cast("int").alias("block")).agg(F.max("y").alias("maximum"), F.count(F.lit(1)).alias("n")).where(F.col("n") == block_size).drop("n")


def var_backtest_counts(df: DataFrame, hit: str, time: str, key: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """(key…, n, n_violations, hit_rate, n00, n01, n10, n11, lr_uc, p_uc, lr_ind, p_ind, lr_cc, p_cc) of a 0/1 column."""
    h = F.col(hit).cast("int")
    base = df.select(*key, h.alias("h"), F.lag(h).over(_ordered(key, time)).alias("b"))
    pair = lambda x, y: F.count_if((F.col("b") == x) & (F.col("h") == y)).alias(f"n{x}{y}")
    m = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("n_violations"), pair(0, 0), pair(0, 1), pair(1, 0), pair(1, 1))
    xlog = lambda x, p: F.when(x == 0, 0.0).otherwise(x * F.log(p))
    n, v = F.col("n"), F.col("n_violations")
    p = v / n
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    rate = lambda a, b: F.when(a + b > 0, b / F.greatest(a + b, F.lit(1))).otherwise(0.0)
    p01, p11 = rate(n00, n01), rate(n10, n11)
    pooled = (n01 + n11) / (n - 1)
    uc = 2 * (xlog(v, p) + xlog(n - v, 1 - p) - xlog(v, F.lit(alpha)) - xlog(n - v, F.lit(1 - alpha)))
    ind = 2 * (xlog(n00, 1 - p01) + xlog(n01, p01) + xlog(n10, 1 - p11) + xlog(n11, p11) - xlog(n00 + n10, 1 - pooled) - xlog(n01 + n11, pooled))
    m = m.withColumns({"hit_rate": p, "lr_uc": uc, "lr_ind": ind, "lr_cc": uc + ind})
    sf = lambda c, d: special.column(special.chi2_sf, c, F.lit(float(d)))
    return m.withColumns({"p_uc": sf("lr_uc", 1), "p_ind": sf("lr_ind", 1), "p_cc": sf("lr_cc", 2)})
