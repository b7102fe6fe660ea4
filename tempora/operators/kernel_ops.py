"""Operators that need a key's whole series at once: numpy kernels run for each key by Spark.

``operator(name)`` gives a function ``f(df, *columns, time, key=(), **options)``; a column argument is a name, or a list of names for a
matrix. Results are rows (key…, field, i, j, k, value, note), see ``plans.kernel``. All operators are also attributes of this module.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from ..functions import diagnostics as D
from ..functions import filters as L
from ..functions import forecasting as C
from ..functions import projections as P
from ..functions import spectest as R
from ..functions import statespace as T
from ..functions import varmodels as V
from ..functions import volatility as G
from ..plans.kernel import grouped


def panel(kernel: Callable[..., dict], matrix: bool = False, ragged: bool = False) -> Callable[..., dict]:
    """A kernel of long columns (unit, values…), rows in order of time, for one that takes units by time, or lists of units."""

    @functools.wraps(kernel)
    def run(unit: np.ndarray, *values: np.ndarray, **options) -> dict:
        units = np.unique(unit)
        if ragged:
            return kernel(*([v[unit == u] for u in units] for v in values), **options)
        sizes = {int((unit == u).sum()) for u in units}
        if len(sizes) != 1:
            raise ValueError("the panel is not balanced: units have different numbers of rows")
        arrays = [np.array([v[unit == u] for u in units]) for v in values]
        if matrix:
            arrays[-1] = np.array([arrays[-1][:, :, j] for j in range(arrays[-1].shape[2])])
        return kernel(*arrays, **options)

    return run


def _panel_lp(outcome: np.ndarray, shock: np.ndarray, **options) -> dict:
    return P.panel_lp(outcome, shock[0], **options)


KERNELS: dict[str, Callable[..., dict]] = {
    **{f.__name__: f for f in (D.pacf, D.arch_lm, D.adf, D.kpss, D.check_stationarity, D.phillips_perron, D.dfgls, D.phillips_ouliaris, D.zivot_andrews, D.ndiffs, D.nsdiffs, D.box_cox_lambda)},
    **{f.__name__: f for f in (R.heteroskedasticity_test, R.reset_test, R.chow_test, R.cusum_test, R.bai_perron, R.sup_f_test, R.setar, R.quantile_regression, R.growth_at_risk, R.iv_gmm)},
    "ols": R.ols_table,
    **{f.__name__: f for f in (L.hp_filter, L.cf_filter, L.hamilton_filter, L.stl, L.seasonal_strength, L.periodogram, L.welch, L.coherence, L.long_memory_d)},
    **{f.__name__: f for f in (T.local_level_smooth, T.ar_loglik, T.arima_fit, T.markov_switching_ar, T.gas_volatility, T.dcs_local_level)},
    **{f.__name__: f for f in (G.garch_fit, G.ccc_garch, G.dcc_garch, G.var_backtest, G.gpd_fit, G.gev_fit, G.copula_fit, G.copula_select)},
    **{
        f.__name__: f
        for f in (
            V.var_fit, V.select_order, V.var_irf, V.var_fevd, V.var_forecast, V.var_granger, V.connectedness, V.rolling_connectedness, V.johansen, V.vecm, V.engle_granger, V.factor_model, V.favar, V.functional_pca,
            V.structural_fevd, V.long_run_svar, V.max_share_svar, V.proxy_svar, V.proxy_first_stage, V.hetero_svar, V.nongaussian_svar, V.historical_decomposition, V.bvar_fit, V.bvar_hierarchical,
        )
    },
    **{f.__name__: f for f in (P.lp, P.lp_iv, P.lp_multiplier, P.lp_state, P.smooth_lp, P.quantile_lp, P.flp, P.flp_scenario, P.fvar_scenario)},
    **{
        f.__name__: f
        for f in (
            C.theta_forecast, C.har_rv, C.ridge, C.elastic_net, C.lasso, C.adaptive_lasso, C.lasso_path, C.umidas, C.weighted_midas, C.dfm_nowcast, C.nelson_siegel, C.svensson, C.dynamic_ns,
            C.afns_adjustment, C.acm_term_premium, C.predictive_regression, C.ivx_test, C.recession_probit, C.cg_regression, C.forecast_efficiency, C.optimal_block_length,
        )
    },
    "panel_fe": panel(P.panel_fe, matrix=True),
    "panel_lp": panel(_panel_lp),
    "lp_did": panel(P.lp_did),
    "panel_mean_group": panel(P.mean_group, ragged=True),
    "panel_pmg": panel(P.panel_pmg, ragged=True),
    "panel_unit_root": panel(P.panel_unit_root, ragged=True),
    "mean_group_var": panel(P.mean_group_var, ragged=True),
}

#: Kernels in which NaN means a missing observation.
MISSING = {"local_level_smooth", "ar_loglik", "dfm_nowcast", "proxy_svar", "proxy_first_stage"}


def mcmc_diagnostics(draws: DataFrame, chain: str, draw: str, value: str, key: Sequence[str] = ()) -> DataFrame:
    """Convergence of (chain, draw, value) rows, for each key."""

    def kernel(chains: np.ndarray, values: np.ndarray) -> dict:
        return V.mcmc_diagnostics(np.array([values[chains == c] for c in np.unique(chains)]))

    return grouped(draws, kernel, [chain, value], time=draw, key=key)


def operator(name: str) -> Callable[..., DataFrame]:
    kernel = KERNELS[name]

    def run(df: DataFrame, *columns, time: str, key: Sequence[str] = (), **options) -> DataFrame:
        return grouped(df, kernel, columns, time, key, allow_missing=name in MISSING, **options)

    run.__name__, run.__doc__ = name, kernel.__doc__
    return run


def __getattr__(name: str) -> Callable[..., DataFrame]:
    if name in KERNELS:
        return operator(name)
    raise AttributeError(name)
