"""The reference operators: SQL results, published values, invariants and errors."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.functions import diagnostics as D
from tempora.functions import filters as L
from tempora.functions import forecasting as C
from tempora.functions import special as S
from tempora.functions import spectest as R
from tempora.functions import statespace as T
from tempora.functions import varmodels as V
from tempora.functions import volatility as G
from tempora.operators import kernel_ops, moment_ops, registry, replication_ops

SF = "/root/testdata/sf0.001"

# Annual flow of the Nile at Aswan, 1871-1970 (public data).
NILE = np.array(
    [1120, 1160, 963, 1210, 1160, 1160, 813, 1230, 1370, 1140, 995, 935, 1110, 994, 1020, 960, 1180, 799, 958, 1140, 1100, 1210, 1150, 1250, 1260, 1220, 1030, 1100, 774, 840, 874, 694, 940, 833, 701, 916, 692, 1020, 1050, 969, 831, 726, 456, 824, 702, 1120, 1100, 832, 764, 821, 768, 845, 864, 862, 698, 845, 744, 796, 1040, 759, 781, 865, 845, 944, 984, 897, 822, 1010, 771, 676, 649, 846, 812, 742, 801, 1040, 860, 874, 848, 890, 744, 749, 838, 1050, 918, 986, 797, 923, 975, 815, 1020, 906, 901, 1170, 912, 746, 919, 718, 714, 740],
    float,
)

NAMES = """acf pacf ljung_box jarque_bera arch_lm adf kpss check_stationarity phillips_perron dfgls phillips_ouliaris zivot_andrews ndiffs nsdiffs box_cox_lambda
long_run_variance ols heteroskedasticity_test reset_test chow_test cusum_test bai_perron sup_f_test hp_filter bk_filter cf_filter hamilton_filter stl seasonal_strength periodogram welch coherence
frac_diff frac_integrate long_memory_d local_level_smooth ar_loglik arima_fit markov_switching_ar setar setar_test garch_fit ccc_garch dcc_garch gas_volatility dcs_local_level realized_measures realized_quarticity
tripower_quarticity bns_jump_test realized_range har_rv var_backtest gpd_fit gev_fit pseudo_obs copula_fit copula_select var_fit var_irf var_irf_bands var_fevd var_forecast var_granger connectedness johansen vecm
engle_granger factor_model favar sign_restricted_svar zero_sign_svar narrative_svar fry_pagan_svar robust_svar_bounds long_run_svar max_share_svar proxy_svar proxy_first_stage proxy_svar_bands proxy_ar_sets
nongaussian_svar hetero_svar structural_fevd historical_decomposition bvar_fit bvar_irf_draws bvar_hierarchical bvar_ssvs mcmc_diagnostics lp lp_iv lp_multiplier lp_state smooth_lp panel_lp lp_did quantile_lp flp
flp_scenario fvar_scenario panel_fe panel_mean_group panel_pmg panel_unit_root mean_group_var accuracy theta_forecast dm_test cw_test gw_test backtest cv_splits ridge elastic_net lasso adaptive_lasso lasso_path
midas_weights umidas weighted_midas dfm_nowcast dfm_news nelson_siegel svensson dynamic_ns afns_adjustment acm_term_premium predictive_regression ivx_test recession_probit cg_regression forecast_efficiency
forecast_disagreement dsge_solve quantile_regression growth_at_risk functional_pca iv_gmm gmm_nonlinear philox_uniforms bootstrap_indices optimal_block_length check_series""".split()


def test_every_operator_has_a_query():
    assert not set(NAMES) - set(registry.registered_queries())


@pytest.mark.parametrize("name", sorted(registry.registered_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.registered_queries()[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda rows: sorted(tuple(repr(x) if isinstance(x, float) else str(x) for x in r) for r in rows)
    want = con.sql(registry.registered_sql()[name])
    assert sorted(want.columns) == columns
    assert norm(df.select(*columns).collect()) == norm(con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({registry.registered_sql()[name]})").fetchall())


def test_published_values():
    a = D.adf(NILE)
    assert (a["statistic"], a["p_value"], a["used_lag"]) == (pytest.approx(-4.048705096914343), pytest.approx(0.001175887950387122, rel=1e-6), 1)
    assert D.kpss(NILE)["statistic"] == pytest.approx(0.8691205593783892)
    assert D.arch_lm(NILE - NILE.mean())["statistic"] == pytest.approx(9.537884066762352)
    ll = T.local_level_smooth(NILE, 15099.0, 1469.1)
    assert ll["loglik"] == pytest.approx(-633.4645636488787)
    fit = T.arima_fit(NILE, 1, 0, 1)
    assert fit["loglik"] >= -637.05  # the maximum that other packages find is -637.0
    g = D.dfgls(NILE)
    assert (g["statistic"], g["used_lag"]) == (pytest.approx(-2.808719753421379), 1)


def test_special_functions():
    assert S.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), rel=1e-12)
    assert S.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert S.f_sf(2.0, 2, 10) == pytest.approx((1 + 2 * 2 / 10) ** -5, rel=1e-12)
    for p in (1e-6, 0.025, 0.5, 0.9, 0.999):
        assert S.norm_cdf(S.norm_ppf(p)) == pytest.approx(p, rel=1e-10)
        assert S.t_cdf(S.t_ppf(p, 4.3), 4.3) == pytest.approx(p, rel=1e-8)
        assert 1 - S.chi2_sf(S.chi2_ppf(p, 3), 3) == pytest.approx(p, rel=1e-6, abs=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_invariants(seed):
    rng = np.random.default_rng(seed)
    y = np.cumsum(rng.standard_normal(60))
    h = L.hp_filter(y)
    assert np.allclose(h["trend"] + h["cycle"], y)
    k = np.diff(np.eye(60), 2, axis=0)
    assert np.allclose(h["trend"], np.linalg.solve(np.eye(60) + 1600 * k.T @ k, y))
    data = rng.standard_normal((80, 3)) + 0.3 * y[:1]
    assert np.allclose(V.var_fevd(data)["fevd"].sum(axis=2), 1)
    lr = V.long_run_svar(data)
    assert np.allclose(lr["impact"] @ lr["impact"].T, V.Var(data).sigma)
    hd = V.historical_decomposition(data[:40])
    assert np.allclose(hd["hd"].sum(axis=2) + hd["baseline"], data[2:40])
    x = np.column_stack([np.ones(80), data[:, :2]])
    assert np.allclose(C.ridge(x, data[:, 2], 0.0)["coef"], np.linalg.lstsq(x, data[:, 2], rcond=None)[0])
    big = C.elastic_net(x, data[:, 2], 1e6, 1.0)
    assert not big["coef"].any()
    c = R.Cumulative(data[:, 2], x)
    assert c.rss(10, 60) == pytest.approx(R.rss(data[10:60, 2], x[10:60]), rel=1e-8)
    s = L.stl(y, 12)
    assert np.allclose(s["seasonal"] + s["trend"] + s["resid"], y)


def test_break_date_published_values():
    """Statistic, p-value, lags and last index before the break, computed elsewhere for the same public series."""
    for options, want in (
        ({"regression": "c"}, (-6.859008939051495, 1e-05, 1, 27)),
        ({"regression": "t"}, (-5.681292678132567, 0.003897907389623101, 1, 43)),
        ({"regression": "ct"}, (-6.841686495384314, 0.0009871952869007973, 1, 27)),
    ):
        r = D.zivot_andrews(NILE, **options)
        assert (r["stat"], r["pvalue"], r["lags"], r["break_index"]) == (pytest.approx(want[0], rel=1e-9), pytest.approx(want[1], rel=1e-7), *want[2:])
    with pytest.raises(ValueError, match="lags"):
        D.zivot_andrews(NILE, lags=20)


def test_long_run_variance_has_no_cap(spark):
    """The default bandwidth of a long series is used whole, and each key has its own."""
    rng = np.random.default_rng(3)
    y = np.convolve(rng.standard_normal(3000), np.ones(8) / 8, "valid")
    df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(y)] + [("b", t, float(v)) for t, v in enumerate(y[:90])], "g string, t int, y double")
    from tempora.functions.linear import lrv

    got = {r.g: (r.lrv, r.bandwidth) for r in moment_ops.long_run_variance(df, "y", "t", ["g"]).collect()}
    for g, v in (("a", y), ("b", y[:90])):
        assert got[g] == (pytest.approx(lrv(v - v.mean())), math.floor(4 * (len(v) / 100) ** (2 / 9)))


def test_arima_constant_is_the_intercept():
    rng = np.random.default_rng(1)
    y = np.zeros(4000)
    for t in range(1, 4000):
        y[t] = 2.0 + 0.6 * y[t - 1] + rng.standard_normal()
    fit = T.arima_fit(y[500:], 1, 0, 0)
    assert fit["param_names"][0] == "const" and fit["params"][0] == pytest.approx(2.0, abs=0.2)
    x = np.column_stack([np.ones(len(y) - 501), y[500:-1]])
    beta, u, inv = __import__("tempora.functions.linear", fromlist=["ols"]).ols(y[501:], x)
    assert fit["params"][:2] == pytest.approx(beta, abs=0.02) and fit["bse"][0] == pytest.approx(math.sqrt(inv[0, 0]), rel=0.05)


def test_frac_diff_is_inverted(spark):
    rows = [(k, t, float(np.sin(t * (k + 1)))) for k in range(2) for t in range(40)]
    df = spark.createDataFrame(rows, "g int, t int, y double")
    there = moment_ops.frac_diff(df, "y", "t", ["g"], 0.35).withColumnRenamed("value", "y")
    back = {(r.g, r.t): r.value for r in moment_ops.frac_integrate(there, "y", "t", ["g"], 0.35).collect()}
    assert all(back[k, t] == pytest.approx(v) for k, t, v in rows)


def test_window_and_kernel_paths_agree(spark):
    rows = [(k, t, float(np.cos(t) + 0.1 * k * t + np.sin(37.0 * t * t))) for k in range(3) for t in range(50)]
    df = spark.createDataFrame(rows, "g int, t int, y double").repartition(7)
    r = {(x.g, x.lag): x.acf for x in moment_ops.acf(df, "y", "t", ["g"], 6).collect()}
    for k in range(3):
        y = np.array([v for g, _, v in rows if g == k])
        d = y - y.mean()
        assert all(r[k, j] == pytest.approx(d[j:] @ d[: 50 - j] / (d @ d)) for j in range(7))
    a = kernel_ops.operator("adf")(df, "y", time="t", key=["g"]).where("field = 'statistic'").collect()
    assert {x.g: x.value for x in a} == {k: pytest.approx(D.adf(np.array([v for g, _, v in rows if g == k]))["statistic"]) for k in range(3)}


def test_replications_do_not_depend_on_partitions(spark):
    from tempora.plans.kernel import replicate

    one, many = ({(r.rep, r.field): r.value for r in replicate(spark, 20, 5, lambda rng, i: {"x": rng.random()}, tasks=n).collect()} for n in (1, 7))
    assert one == many
    u = [r.value for r in replication_ops.philox_uniforms(spark, 3, 25).orderBy("i").collect()]
    assert np.array_equal(u, C.philox_uniforms(3, 25))


def test_errors(spark):
    df = spark.createDataFrame([(t, float(t), None if t == 3 else 1.0) for t in range(20)], "t int, y double, z double")
    with pytest.raises(ValueError, match="no column"):
        kernel_ops.operator("adf")(df, "missing", time="t")
    with pytest.raises(Exception, match="missing or infinite"):
        kernel_ops.operator("adf")(df, "z", time="t").collect()
    with pytest.raises(ValueError, match="forecaster"):
        moment_ops.backtest(df, "y", "t", forecaster="oracle")
    with pytest.raises(ValueError, match="positive"):
        D.box_cox_lambda(np.array([1.0, -1.0]))
    with pytest.raises(ValueError, match="twenty pairs"):
        G.copula_fit(np.ones((5, 2)))


def test_models_recover_parameters():
    rng = np.random.default_rng(7)
    n = 3000
    e, h = np.zeros(n), 1.0
    for t in range(n):
        e[t] = math.sqrt(h) * rng.standard_normal()
        h = 0.1 + 0.1 * e[t] ** 2 + 0.8 * h
    f = G.garch_fit(e)
    assert f["params"] == pytest.approx([0.1, 0.1, 0.8], abs=0.06)
    y = np.zeros(1500)
    for t in range(1, 1500):
        y[t] = 0.6 * y[t - 1] + rng.standard_normal()
    assert T.arima_fit(y, 1, 0, 0)["params"][1] == pytest.approx(0.6, abs=0.06)
    x = np.column_stack([np.ones(2000), rng.standard_normal(2000)])
    q = R.quantile_regression(1 + 2 * x[:, 1] + rng.standard_normal(2000), x, [0.5])
    assert q["params"][0] == pytest.approx([1, 2], abs=0.1)
    breaks = R.bai_perron(np.r_[rng.standard_normal(60), 3 + rng.standard_normal(60)], np.ones((120, 1)), 3)
    assert breaks["n_breaks"] == 1 and abs(breaks["break_dates"][0] - 59) <= 3


def test_summarize(spark):
    df = spark.createDataFrame([(t, float(v)) for t, v in enumerate(NILE)], "t int, y double")
    text = replication_ops.summarize(kernel_ops.operator("adf")(df, "y", time="t"), "ADF")
    assert "statistic" in text and "-4.0487" in text
    checked = {r.field: r for r in replication_ops.check_series(df, "y", "t").collect()}
    assert checked["stationarity.quadrant"].note == "Conflict" and "recommendations" in checked


def test_robust_bounds_are_the_edges_of_the_set(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.standard_normal((120, 3)), axis=0) * 0.1 + rng.standard_normal((120, 3)) @ np.array([[1, 0.4, 0.2], [0, 1, 0.3], [0, 0, 1]])
    df = spark.createDataFrame([(t, *map(float, r)) for t, r in enumerate(y)], "t long, a double, b double, c double")
    signs = [(0, 0, 0, 1), (1, 0, 0, 1)]
    out = {(r.i, r.j, r.k): r for r in replication_ops.robust_svar_bounds(df, ["a", "b", "c"], "t", signs, horizon=2, n_draws=8).collect()}
    assert {k for _, _, k in out} == {0}
    assert abs(out[0, 0, 0].set_lower_mean) < 1e-8 and abs(out[0, 1, 0].set_lower_mean) < 1e-8
    normals, q = rng.standard_normal((2, 3)), rng.standard_normal((200_000, 3))
    q = q[(q @ normals.T >= 0).all(axis=1)] / np.linalg.norm(q[(q @ normals.T >= 0).all(axis=1)], axis=1, keepdims=True)
    for g in rng.standard_normal((20, 3)):
        low, high = replication_ops.sphere_bounds(g, normals)
        assert low - 1e-9 <= (q @ g).min() <= low + 0.05 and high - 0.05 <= (q @ g).max() <= high + 1e-9
    assert replication_ops.sphere_bounds(np.array([1.0, 2.0]), np.array([[1.0, 0.0], [-1.0, 0.1], [0.0, -1.0]])) is None


def test_factor_queries_take_all_elements(spark):
    d = "/root/testdata/sf0.001"
    size = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("max(size(embedding)) n").first().n
    queries = registry.registered_queries()
    rows = {name: queries[name](spark, d).where("field = 'loadings'").collect() for name in ("factor_model", "favar")}
    assert {name: len({r.i for r in out}) for name, out in rows.items()} == {"factor_model": size, "favar": size - 1}


def test_ssvs_of_nearly_collinear_series(spark):
    """Counts, averages and their products of many rows: the sampler keeps its digits, and units change nothing."""
    rng = np.random.default_rng(5)
    n, a = 110_000 * (1 + 1e-4 * rng.standard_normal(80)), 150 + 1e-4 * rng.standard_normal(80)
    data = np.column_stack([n * a / 1e3, n, a])
    got = []
    for scale in ([1.0, 1.0, 1.0], [2.0**-7, 2.0**-12, 2.0**5]):
        df = spark.createDataFrame([(t, *map(float, r)) for t, r in enumerate(data * scale)], "t int, y double, n double, a double")
        out = replication_ops.bvar_ssvs(df, ["y", "n", "a"], "t", n_draws=20, burn=10).collect()
        assert len(out) == 42 and all(r.value is not None and math.isfinite(r.value) for r in out)
        got.append({(r.i, r.j): r.value for r in out if r.field == "inclusion_prob"})
    assert got[0] == got[1]


def test_ssvs_coefficients_are_the_posterior_mean():
    rng = np.random.default_rng(2)
    z, p, d = rng.standard_normal((30, 3)), np.tril(rng.standard_normal((2, 2))), rng.random((3, 2))
    y = rng.standard_normal((30, 2))
    r = np.linalg.qr(z, mode="r")
    b = np.linalg.lstsq(z, y, rcond=None)[0]
    big = np.kron(p @ p.T, z.T @ z) + np.diag(1 / d.T.ravel())
    mean = np.linalg.solve(big, (z.T @ y @ p @ p.T).T.ravel()).reshape(2, 3).T
    draw = lambda e: replication_ops.ssvs_coefficients(r, r @ b, p, d, e)
    assert np.allclose(draw(np.zeros(6)), mean)
    half = np.array([(draw(e) - mean).T.ravel() for e in np.eye(6)])
    assert np.allclose(half.T @ half, np.linalg.inv(big))


def test_reset_of_a_fit_that_varies_little():
    """Powers of such a fit are collinear in floating point; the statistic does not change when the series moves by a constant."""
    rng = np.random.default_rng(11)
    x = np.column_stack([np.ones(400), 1e-3 * rng.standard_normal((400, 2))])
    line = x @ np.array([0.0, 1.0, 2.0])
    y = line + 20 * line**2 + 1e-4 * rng.standard_normal(400)
    want = R.reset_test(y, x)
    assert want["fstat"] > 5
    for shift in (1.0, 35.0):
        assert R.reset_test(y + shift, x)["fstat"] == pytest.approx(want["fstat"], rel=1e-6)
    b, u, _ = __import__("tempora.functions.linear", fromlist=["ols"]).ols(y, x)
    plain = R.rss(y, np.column_stack([x, ((y - u) * 1e3) ** 2, ((y - u) * 1e3) ** 3]))
    assert want["fstat"] == pytest.approx((u @ u - plain) / 2 / (plain / 395), rel=1e-6)


def test_var_backtest_without_violations(spark, tmp_path):
    """Days of nearly equal revenue: no return is a violation, and the query says what its SQL says."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT TIMESTAMP '2000-01-01' + to_days(i::INT) AS l_shipdate, 100.0::DOUBLE + i % 7 AS l_extendedprice, 0.0::DOUBLE AS l_discount FROM range(800) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    out = registry.registered_queries()["var_backtest"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({registry.registered_sql()['var_backtest']})").fetchall()
    assert sorted(tuple(map(repr, r)) for r in out.collect()) == sorted(tuple(map(repr, r)) for r in want)
    r = G.var_backtest(np.zeros(100))
    assert (r["lr_uc"], r["lr_ind"], r["p_ind"], r["n00"]) == (pytest.approx(-200 * math.log(0.95)), 0, 1, 99)
    assert math.isnan(r["dq"]) and r["p_dq"] == pytest.approx(S.chi2_sf(96 * 0.05 / 0.95, 1))
    r = G.var_backtest(np.ones(100))
    assert (r["lr_uc"], r["n11"], r["lr_ind"]) == (pytest.approx(-200 * math.log(0.05)), 99, 0) and math.isnan(r["dq"])
    r = G.var_backtest(np.eye(100)[99])
    assert math.isnan(r["dq"]) and math.isfinite(r["p_dq"])
    with pytest.raises(ValueError, match="too few"):
        G.var_backtest(np.zeros(10))
