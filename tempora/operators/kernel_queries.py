"""Queries of the grouped kernels over the given tables, and SQL of those that SQL can tell."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import series as S
from . import kernel_ops, kernel_sql, replication_ops, system_sql
from .registry import query, rounded

#: Only these fields of a result, where the whole would be many rows.
HEAD = ("statistic", "stat", "p_value", "pvalue", "lags", "used_lag", "nobs", "params", "bse", "loglik")


def _months(spark, d):
    w = Window.orderBy("t")
    m = S.monthly(spark, d)
    return m.withColumns({"c": F.lit(1.0), "lag": F.coalesce(F.lag("y").over(w), F.col("y")), "high": (F.col("y") > F.avg("y").over(Window.partitionBy(F.lit(0)))).cast("double"), "z": F.col("n") / 100 + F.sin(F.month("t").cast("double"))})


def _reg(spark, d):
    return S.regression(spark, d)


def _returns(spark, d):
    return S.returns(spark, d).withColumn("r2", F.col("r") * F.col("r"))


def _panel(spark, d):
    return S.type_days(spark, d).withColumn("unit", F.dense_rank().over(Window.orderBy("g")).cast("double")).withColumn("day", F.datediff("t", F.lit("2024-01-01")).cast("double")).withColumn("wave", F.sin(F.col("day") * F.col("day")))


def _treated(spark, d):
    return _panel(spark, d).withColumn("d", ((F.col("unit") <= 2) & (F.col("day") >= 8 + 4 * F.col("unit"))).cast("double"))


#: Elements of a vector of the embeddings table, and the one that stands for policy.
ELEMENTS, POLICY = 64, 8


def _embeddings(spark, d):
    e = S.table(spark, d, "embeddings")
    return e.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(ELEMENTS)), F.get("embedding", F.lit(POLICY)).cast("double").alias("policy"))


def _uniforms(spark, d):
    w = Window.partitionBy(F.lit(0))
    m = S.monthly(spark, d)
    n = F.count(F.lit(1)).over(w) + 1
    return m.select("t", (F.row_number().over(Window.orderBy("y", "t")) / n).alias("u"), (F.row_number().over(Window.orderBy("n", "t")) / n).alias("v"))


def _curves(spark, d):
    """(t, y1, y2, …): a yield-like curve of each month from average prices."""
    m = _months(spark, d)
    return m.select("t", "y", *((F.lit(2.0) + F.col("a") / 100 + F.col("n") / 400 * F.exp(F.lit(-k / 12.0)) + F.col("y") / 100 * F.lit(k / 60.0)).alias(f"y{k}") for k in (1, 2, 3, 6, 7, 12, 13, 24, 36)))


CURVE = [f"y{k}" for k in (1, 2, 3, 6, 7, 12, 13, 24, 36)]


def _points(spark, d):
    """(t, m, v): the same as points of a curve."""
    c = _curves(spark, d)
    return c.select("t", F.explode(F.array(*(F.struct(F.lit(float(n[1:])).alias("m"), F.col(n).alias("v")) for n in CURVE))).alias("p")).select("t", "p.m", "p.v")


def _hits(spark, d):
    return S.returns(spark, d).select("t", (F.col("r") < -0.6).cast("double").alias("hit"))


def _ragged(spark, d):
    m = _months(spark, d)
    last = F.max("t").over(Window.partitionBy(F.lit(0)))
    return m.select("t", "y", "n", F.when(F.col("t") < last, F.col("a")).otherwise(F.lit(float("nan"))).alias("a"))


X = ["c", "x1", "x2"]
V3 = ["y", "n", "a"]

#: (query, source, columns, time, key, options)
PLAIN = [
    ("pacf", S.type_days, ["y"], "t", ["g"], {"nlags": 8}),
    ("pacf_ols", S.type_days, ["y"], "t", ["g"], {"nlags": 6, "method": "ols"}),
    ("arch_lm", _returns, ["r"], "t", [], {}),
    ("adf", S.type_days, ["y"], "t", ["g"], {}),
    ("kpss", S.type_days, ["y"], "t", ["g"], {}),
    ("check_stationarity", S.type_days, ["y"], "t", ["g"], {}),
    ("phillips_perron", _months, ["y"], "t", [], {}),
    ("dfgls", _months, ["y"], "t", [], {}),
    ("phillips_ouliaris", _months, ["y", ["n"]], "t", [], {}),
    ("zivot_andrews", _months, ["a"], "t", [], {}),
    ("ndiffs", S.type_days, ["y"], "t", ["g"], {}),
    ("nsdiffs", _months, ["y"], "t", [], {"period": 12}),
    ("box_cox_lambda", _months, ["y"], "t", [], {}),
    ("ols", _reg, ["y", X], "t", [], {}),
    ("ols_hc3", _reg, ["y", X], "t", [], {"se_type": "hc3"}),
    ("heteroskedasticity_test", _reg, ["y", X], "t", [], {}),
    ("heteroskedasticity_test_bp", _reg, ["y", X], "t", [], {"test": "bp"}),
    ("reset_test", _reg, ["y", X], "t", [], {}),
    ("chow_test", _months, ["y", ["c", "n"]], "t", [], {"split": 40}),
    ("cusum_test", _months, ["y", ["c", "n"]], "t", [], {}),
    ("bai_perron", _months, ["y", ["c"]], "t", [], {"max_breaks": 3}),
    ("sup_f_test", _months, ["y", ["c", "n"]], "t", [], {}),
    ("hp_filter", _months, ["y"], "t", [], {}),
    ("hp_filter_one_sided", _months, ["y"], "t", [], {"one_sided": True}),
    ("cf_filter", _months, ["y"], "t", [], {}),
    ("hamilton_filter", _months, ["y"], "t", [], {}),
    ("stl", _months, ["y"], "t", [], {"period": 12}),
    ("seasonal_strength", _months, ["y"], "t", [], {"period": 12}),
    ("periodogram", _months, ["y"], "t", [], {"detrend": "constant"}),
    ("welch", _returns, ["r"], "t", [], {}),
    ("coherence", _reg, ["y", "x1"], "t", [], {}),
    ("long_memory_d", _returns, ["r2"], "t", [], {}),
    ("local_level_smooth", _months, ["y"], "t", [], {"sigma2_eps": 4.0, "sigma2_eta": 1.0}),
    ("ar_loglik", _returns, ["r"], "t", [], {"coeffs": [-0.4, -0.2], "sigma2": 0.1}),
    ("arima_fit", _months, ["y"], "t", [], {"p": 1, "q": 1, "forecast_steps": 6, "conf_alpha": 0.1}),
    ("arima_fit_many", S.type_days, ["y"], "t", ["g"], {"p": 1}),
    ("markov_switching_ar", _months, ["y"], "t", [], {"max_iter": 60}),
    ("setar", _months, ["a"], "t", [], {"p": 1}),
    ("garch_fit", _returns, ["r"], "t", [], {"forecast_horizon": 5}),
    ("ccc_garch", _months, [["y", "a"]], "t", [], {}),
    ("dcc_garch", _months, [["y", "a"]], "t", [], {}),
    ("gas_volatility", _months, ["z"], "t", [], {"horizon": 3}),
    ("dcs_local_level", _months, ["a"], "t", [], {}),
    ("har_rv", _returns, ["r2"], "t", [], {}),
    ("var_backtest", _hits, ["hit"], "t", [], {}),
    ("gpd_fit", _returns, ["r2"], "t", [], {"p_tail": 0.01}),
    ("gev_fit", _returns, ["r2"], "t", [], {"block_size": 30}),
    ("copula_fit", _uniforms, [["u", "v"]], "t", [], {}),
    ("copula_select", _uniforms, [["u", "v"]], "t", [], {"families": ["gaussian", "frank", "clayton", "gumbel"]}),
    ("var_fit", _months, [V3], "t", [], {}),
    ("select_order", _months, [V3], "t", [], {"max_lags": 4}),
    ("var_irf", _months, [V3], "t", [], {"horizon": 8}),
    ("var_fevd", _months, [V3], "t", [], {"horizon": 8}),
    ("var_forecast", _months, [V3], "t", [], {}),
    ("var_granger", _months, [V3], "t", [], {"caused": [0], "causing": [1]}),
    ("connectedness", _months, [V3], "t", [], {}),
    ("rolling_connectedness", _months, [V3], "t", [], {"window": 50}),
    ("johansen", _months, [V3], "t", [], {}),
    ("vecm", _months, [V3], "t", [], {}),
    ("engle_granger", _months, [V3], "t", [], {}),
    ("factor_model", _embeddings, [[f"e{i}" for i in range(ELEMENTS)]], "vec_id", [], {"kmax": 5}),
    ("favar", _embeddings, [[f"e{i}" for i in range(ELEMENTS) if i != POLICY], "policy"], "vec_id", [], {"horizon": 6}),
    ("functional_pca", _curves, [CURVE], "t", [], {}),
    ("structural_fevd", _months, [V3], "t", [], {}),
    ("long_run_svar", _months, [V3], "t", [], {}),
    ("max_share_svar", _months, [V3], "t", [], {"h1": 12, "horizon": 12}),
    ("proxy_svar", _months, [V3, "z"], "t", [], {}),
    ("proxy_first_stage", _months, [V3, "z"], "t", [], {}),
    ("hetero_svar", _months, [V3, "high"], "t", [], {}),
    ("nongaussian_svar", _months, [V3], "t", [], {}),
    ("historical_decomposition", _months, [V3], "t", [], {}),
    ("bvar_fit", _months, [V3], "t", [], {}),
    ("bvar_hierarchical", _months, [V3], "t", [], {}),
    ("lp", _months, ["y", "z"], "t", [], {"horizons": 6}),
    ("lp_iv", _months, ["y", "n", "z"], "t", [], {"horizons": 6}),
    ("lp_multiplier", _months, ["y", "n", "z"], "t", [], {"horizons": 6}),
    ("lp_state", _months, ["y", "z", "high"], "t", [], {"horizons": 6}),
    ("smooth_lp", _months, ["y", "z"], "t", [], {"horizons": 8}),
    ("quantile_lp", _months, ["y", "z"], "t", [], {"horizons": 3}),
    ("flp", _months, ["y", ["n", "a"]], "t", [], {}),
    ("flp_scenario", _curves, ["y", CURVE], "t", [], {"delta": [0.1] * 9, "n_factors": 2}),
    ("fvar_scenario", _curves, ["y", CURVE], "t", [], {"delta": [0.1] * 9, "n_factors": 2}),
    ("panel_fe", _panel, ["unit", "y", ["x", "day"]], "t", [], {}),
    ("panel_lp", _panel, ["unit", "y", "wave"], "t", [], {"horizon": 3}),
    ("lp_did", _treated, ["unit", "y", "d"], "t", [], {"pre_window": 2, "post_window": 3}),
    ("panel_mean_group", _panel, ["unit", "y", ["x"]], "t", [], {}),
    ("panel_mean_group_cce", _panel, ["unit", "y", ["x"]], "t", [], {"method": "cce"}),
    ("panel_pmg", _panel, ["unit", "y", ["x"]], "t", [], {}),
    ("panel_unit_root", _panel, ["unit", "y"], "t", [], {"test": "ips"}),
    ("mean_group_var", _panel, ["unit", ["y", "x"]], "t", [], {}),
    ("theta_forecast", _months, ["y"], "t", [], {"period": 12}),
    ("ridge", _reg, [X, "y"], "t", [], {}),
    ("elastic_net", _reg, [X, "y"], "t", [], {}),
    ("lasso", _reg, [X, "y"], "t", [], {}),
    ("adaptive_lasso", _reg, [X, "y"], "t", [], {}),
    ("lasso_path", _reg, [X, "y"], "t", [], {"n_lambdas": 30}),
    ("umidas", _months, ["y", ["n", "a", "lag"]], "t", [], {}),
    ("weighted_midas", _months, ["y", ["n", "a", "lag"]], "t", [], {}),
    ("dfm_nowcast", _ragged, [V3], "t", [], {}),
    ("nelson_siegel", _points, ["m", "v"], "m", ["t"], {}),
    ("svensson", _points, ["m", "v"], "m", ["t"], {}),
    ("dynamic_ns", _curves, [CURVE], "t", [], {"maturities": [1, 2, 3, 6, 7, 12, 13, 24, 36]}),
    ("afns_adjustment", _points, ["m"], "m", ["t"], {"sigma": [0.01, 0.02, 0.03]}),
    ("acm_term_premium", _curves, [CURVE], "t", [], {"maturities": [1, 2, 3, 6, 7, 12, 13, 24, 36], "n_factors": 2}),
    ("predictive_regression", _months, ["y", "a"], "t", [], {}),
    ("ivx_test", _months, ["y", ["n", "a"]], "t", [], {}),
    ("recession_probit", _months, ["high", ["c", "lag"]], "t", [], {}),
    ("cg_regression", _months, ["y", "n"], "t", [], {}),
    ("forecast_efficiency", _months, ["y", ["n", "a"]], "t", [], {}),
    ("quantile_regression", _reg, ["y", X], "t", [], {"taus": [0.25, 0.5]}),
    ("growth_at_risk", _months, ["y", ["n"]], "t", [], {}),
    ("iv_gmm", _reg, [["c", "x1"], ["c", "x1", "x2"], "y"], "t", [], {}),
    ("optimal_block_length", _returns, ["r"], "t", [], {}),
]


#: A field whose undefined value is NaN in the query's SQL; results of kernels hold null there.
UNDEFINED = {"var_backtest": "dq"}


def _register(name, source, columns, time, key, options):
    base = name if name in kernel_ops.KERNELS else next(k for k in sorted(kernel_ops.KERNELS, key=len, reverse=True) if name.startswith(f"{k}_"))

    digits, sql = (kernel_sql.SQL | system_sql.SQL).get(name, (None, None))

    @query(name, sql)
    def run(spark, d):
        out = kernel_ops.operator(base)(source(spark, d), *columns, time=time, key=key, **options)
        if name in UNDEFINED:
            out = out.withColumn("value", F.when((F.col("field") == UNDEFINED[name]) & F.col("value").isNull(), F.lit(float("nan"))).otherwise(F.col("value")))
        return out if digits is None else rounded(out, digits)

    run.__name__ = name


for _entry in PLAIN:
    _register(*_entry)


SIGNS = [(0, 0, 0, 1), (1, 0, 0, 1), (2, 1, 0, 1)]


@query("philox_uniforms")
def philox_uniforms(spark, d):
    return replication_ops.philox_uniforms(spark, 42, 64)


@query("bootstrap_indices")
def bootstrap_indices(spark, d):
    return replication_ops.bootstrap_indices(spark, 100, replications=8)


@query("setar_test")
def setar_test(spark, d):
    return replication_ops.setar_test(_months(spark, d), "a", "t", n_boot=99)


@query("var_irf_bands")
def var_irf_bands(spark, d):
    return replication_ops.var_irf_bands(_months(spark, d), V3, "t", horizon=6, n_boot=200)


@query("sign_restricted_svar")
def sign_restricted_svar(spark, d):
    return replication_ops.sign_restricted_svar(_months(spark, d), V3, "t", SIGNS, horizon=6, n_draws=60)


@query("zero_sign_svar")
def zero_sign_svar(spark, d):
    return replication_ops.zero_sign_svar(_months(spark, d), V3, "t", SIGNS[:2], [(2, 0, 0)], horizon=6, n_draws=60)


@query("narrative_svar")
def narrative_svar(spark, d):
    return replication_ops.narrative_svar(_months(spark, d), V3, "t", SIGNS, [(0, 10, 1)], horizon=6, n_draws=60)


@query("fry_pagan_svar")
def fry_pagan_svar(spark, d):
    return replication_ops.fry_pagan_svar(_months(spark, d), V3, "t", SIGNS, horizon=6, n_draws=60)


@query("robust_svar_bounds")
def robust_svar_bounds(spark, d):
    return replication_ops.robust_svar_bounds(_months(spark, d), V3, "t", SIGNS[:2], horizon=6, n_draws=40)


@query("proxy_svar_bands")
def proxy_svar_bands(spark, d):
    return replication_ops.proxy_svar_bands(_months(spark, d), V3, "z", "t", horizon=6, n_boot=100)


@query("proxy_ar_sets")
def proxy_ar_sets(spark, d):
    return replication_ops.proxy_ar_sets(_months(spark, d), V3, "z", "t", horizon=6)


@query("bvar_irf_draws")
def bvar_irf_draws(spark, d):
    return replication_ops.bvar_irf_draws(_months(spark, d), V3, "t", horizon=6, n_draws=50)


@query("bvar_ssvs")
def bvar_ssvs(spark, d):
    return replication_ops.bvar_ssvs(_months(spark, d), V3, "t", n_draws=100, burn=50)


@query("mcmc_diagnostics")
def mcmc_diagnostics(spark, d):
    draws = replication_ops.bvar_irf_draws(_months(spark, d), V3, "t", horizon=2, n_draws=80)
    chains = draws.select((F.col("rep") % 4).cast("double").alias("chain"), "rep", "value", "i", "j", "k").where("i = 1 AND j = 0")
    return kernel_ops.mcmc_diagnostics(chains.withColumnsRenamed({"i": "h", "j": "response", "k": "shock"}), "chain", "rep", "value", ["h", "response", "shock"])


@query("dfm_news")
def dfm_news(spark, d):
    new = _months(spark, d).select("t", *V3)
    return replication_ops.dfm_news(_ragged(spark, d), new, V3, "t")


@query("dsge_solve")
def dsge_solve(spark, d):
    return replication_ops.dsge_solve(spark, [[1.0, 0.0], [0.0, 0.95]], [[0.9, 0.0], [-0.1, 1.0]], [[1.0], [0.0]], 1)


def _mean_and_variance(theta, data):
    import numpy as np

    x = data[:, 0]
    return np.column_stack([x - theta[0], (x - theta[0]) ** 2 - theta[1]])


@query("gmm_nonlinear")
def gmm_nonlinear(spark, d):
    return replication_ops.gmm_nonlinear(_months(spark, d), ["a"], "t", _mean_and_variance, [100.0, 50.0])


@query("check_series")
def check_series(spark, d):
    return replication_ops.check_series(_months(spark, d), "y", "t", seasonal_period=12)
