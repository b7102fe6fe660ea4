"""Published response surfaces and critical values. They must equal the published ones."""

from __future__ import annotations

import numpy as np

from .special import norm_cdf

# MacKinnon (1994, 2010) tau surfaces for one variable: (star, min, max, small-p, large-p, 1/5/10 % coefficients).
MACKINNON = {
    "n": (-1.04, -19.04, np.inf, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066), ((-2.56574, -2.2358, -3.627, 0.0), (-1.94100, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364))),
    "c": (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809, 0.0))),
    "ct": (-2.89, -16.18, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285), ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380))),
}

# Surfaces of the DF-GLS statistic (constant; constant and trend).
DFGLS = {
    "c": (-0.4795076091714674, -17.561302895074206, 13.365361509140614, (0.67422739, 1.25475826, 0.03572509), (0.50612497, 0.98305664, -0.05648525, 0.00140875), ((-2.56781793, -20.5575392, 182.727674, -1778.66664), (-1.94363325, -21.7272746, 260.815068, -2269.14916), (-1.61998241, -23.2734708, 306.474378, -2574.83557))),
    "ct": (-2.1960404365401298, -13.681153542634465, 8.73743383728356, (2.38767685, 1.57454737, 0.05754439), (2.60561421, 1.67850224, 0.0373599, -0.01017936), ((-3.40689134, -21.69971242, 27.26295939, -816.84404772), (-2.84677178, -19.69109364, 84.7664136, -799.40722401), (-2.55890707, -19.42621991, 116.53759752, -840.31342847))),
}

# Surfaces of the normalised-bias (z) statistic: (star, small-p in log|z|, large-p, coefficients).
ADF_Z = {
    "n": (-1.79146, (0.05872, -0.69633, 0.02471, -0.04283), (0.56681, 0.67544, 0.06881, 0.00235), ((-13.30499, 331.55385, -8807.11008, 88544.76648), (-7.82957, 222.75548, -5863.14998, 58024.48295), (-5.57486, 170.79065, -4422.48027, 43264.68244))),
    "c": (-5.04709, (1.94205, -1.47677, 0.21163, -0.06288), (1.70059, 0.49465, 0.02636, 0.00055), ((-20.6258, 119.28619, -442.99517, 1082.9222), (-14.09457, 58.46106, -164.08684, 479.02908), (-11.25118, 38.48786, -87.62853, 246.93531))),
    "ct": (-9.22766, (4.05596, -2.34128, 0.41403, -0.08312), (2.60323, 0.39217, 0.01321, 0.00019), ((-29.3568, 232.33249, -1171.21447, 3166.83631), (-21.71085, 130.15894, -504.95264, 1170.38109), (-18.24475, 93.25896, -305.14509, 581.02963))),
}

# Tau surfaces of residuals of a regression on other variables, for 2 to 6 variables.
COINT_P = {
    "n": (
        (-1.53, -19.62, 1.51, (1.9129, 1.3857, 0.035322), (1.5578, 0.8558, -0.2083, -0.033549)),
        (-2.68, -21.21, 0.86, (2.7648, 1.4502, 0.034186), (2.2268, 0.68093, -0.32362, -0.054448)),
        (-3.09, -23.25, 0.88, (3.4336, 1.4835, 0.0319), (2.7654, 0.64502, -0.30811, -0.044946)),
        (-3.07, -21.63, 1.05, (4.0999, 1.5533, 0.0359), (3.2684, 0.68051, -0.26778, -0.034972)),
        (-3.77, -25.74, 1.24, (4.5388, 1.5344, 0.029807), (3.7268, 0.7167, -0.23648, -0.028288)),
    ),
    "c": (
        (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
        (-3.13, -23.48, 0.55, (3.4699, 1.4856, 0.03164), (2.5893, 0.45168, -0.36529, -0.050074)),
        (-3.47, -28.07, 0.61, (3.9673, 1.4777, 0.026315), (3.0387, 0.45452, -0.33666, -0.041921)),
        (-3.78, -25.96, 0.79, (4.5509, 1.5338, 0.029545), (3.5049, 0.52098, -0.29158, -0.033468)),
        (-3.93, -23.27, 1.0, (5.1399, 1.6036, 0.034445), (3.9489, 0.58933, -0.25359, -0.02721)),
    ),
    "ct": (
        (-3.19, -21.15, 0.63, (3.6646, 1.5419, 0.036448), (2.85, 0.5272, -0.36622, -0.051695)),
        (-3.5, -25.37, 0.71, (4.0983, 1.5173, 0.029898), (3.221, 0.5255, -0.32685, -0.041501)),
        (-3.65, -26.63, 0.93, (4.5844, 1.5338, 0.028796), (3.652, 0.59758, -0.27483, -0.032081)),
        (-3.8, -26.53, 1.19, (5.0722, 1.5634, 0.029472), (4.0712, 0.66428, -0.23464, -0.02546)),
        (-4.36, -26.18, 1.42, (5.53, 1.5914, 0.030392), (4.4735, 0.71757, -0.20681, -0.021196)),
    ),
}

# 1/5/10 % coefficients of the same with a constant, for 2 to 6 variables.
COINT_CRIT_C = (
    ((-3.89644, -10.9519, -33.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.72, 0.0)),
    ((-4.29374, -14.4354, -33.195, 47.433), (-3.74066, -8.5632, -10.852, 27.982), (-3.45218, -6.2143, -3.718, 0.0)),
    ((-4.64332, -18.1031, -37.972, 0.0), (-4.096, -11.2349, -11.175, 0.0), (-3.8102, -8.3931, -4.137, 0.0)),
    ((-4.95756, -21.8883, -45.142, 0.0), (-4.41519, -14.0405, -12.575, 0.0), (-4.13157, -10.7417, -3.784, 0.0)),
    ((-5.24568, -25.6688, -57.737, 88.639), (-4.70693, -16.9178, -17.492, 60.007), (-4.42501, -13.1875, -5.104, 27.877)),
)

# KPSS (1992) at 10, 5, 2.5 and 1 %.
KPSS = {"c": (0.347, 0.463, 0.574, 0.739), "ct": (0.119, 0.146, 0.176, 0.216)}
KPSS_P = (0.10, 0.05, 0.025, 0.01)

# Simulated quantiles (in percent) of the break-date minimum statistic; between them p is interpolated.
ZA_PERCENT = (
    0.001, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 2.5, 5.0, 7.5, 10.0, 12.5, 15.0, 17.5, 20.0, 22.5, 25.0, 27.5, 30.0, 32.5, 35.0, 37.5, 40.0,
    42.5, 45.0, 47.5, 50.0, 52.5, 55.0, 57.5, 60.0, 65.0, 70.0, 75.0, 80.0, 85.0, 90.0, 92.5, 95.0, 96.0, 97.0, 98.0, 99.0, 99.9,
)
ZA = {
    "c": (
        -6.78442, -5.83192, -5.68139, -5.58461, -5.51308, -5.45043, -5.39924, -5.36023, -5.33219, -5.30294, -5.27644, -5.0334, -4.81067, -4.67636, -4.56618,
        -4.4813, -4.40507, -4.33947, -4.28155, -4.22683, -4.1783, -4.13101, -4.08586, -4.04455, -4.0038, -3.96144, -3.92078, -3.88178, -3.84503, -3.80549,
        -3.77031, -3.73209, -3.696, -3.65985, -3.62126, -3.5458, -3.46848, -3.38533, -3.29112, -3.17832, -3.04165, -2.95146, -2.83179, -2.76465, -2.68624,
        -2.57884, -2.40044, -1.88932,
    ),
    "t": (
        -83.9094, -13.8837, -9.13205, -6.32564, -5.60803, -5.38794, -5.26585, -5.18734, -5.12756, -5.07984, -5.03421, -4.65634, -4.4058, -4.25214, -4.13678,
        -4.03765, -3.95185, -3.87945, -3.81295, -3.75273, -3.69836, -3.64785, -3.59819, -3.55146, -3.50522, -3.45987, -3.41672, -3.37465, -3.33394, -3.29393,
        -3.25316, -3.21244, -3.17124, -3.13211, -3.09204, -3.01135, -2.92897, -2.83614, -2.73893, -2.6284, -2.49611, -2.41337, -2.3082, -2.25797, -2.19648,
        -2.1132, -1.99138, -1.67466,
    ),
    "ct": (
        -38.178, -6.43107, -6.07279, -5.95496, -5.86254, -5.77081, -5.72541, -5.68406, -5.65163, -5.60419, -5.57556, -5.29704, -5.07332, -4.93003, -4.82668,
        -4.73711, -4.6602, -4.5897, -4.52855, -4.471, -4.42011, -4.37387, -4.32705, -4.28126, -4.23793, -4.19822, -4.158, -4.11946, -4.08064, -4.04286,
        -4.00489, -3.96837, -3.932, -3.89496, -3.85577, -3.77795, -3.69794, -3.61852, -3.52485, -3.41665, -3.28527, -3.19724, -3.08769, -3.03088, -2.96091,
        -2.85581, -2.71015, -2.28767,
    ),
}


def poly(coefficients, x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


def surface_p(stat: float, surface: tuple) -> float:
    star, low, high, small, large = surface[:5]
    if stat > high:
        return 1.0
    if stat < low:
        return 0.0
    return norm_cdf(poly(small if stat <= star else large, stat))


def surface_crit(surface: tuple, nobs: int) -> list[float]:
    return [poly(row, 1 / nobs) for row in surface[-1]]


def z_p(stat: float, regression: str) -> float:
    star, small, large, _ = ADF_Z[regression]
    return norm_cdf(poly(small, np.log(abs(stat))) if stat <= star else poly(large, stat))


def coint_p(stat: float, trend: str, n_vars: int) -> float:
    return surface_p(stat, COINT_P[trend][n_vars - 2]) if 2 <= n_vars <= 6 and trend in COINT_P else float("nan")


def coint_crit(n_vars: int, nobs: int, trend: str = "c") -> list[float]:
    return [poly(row, 1 / nobs) for row in COINT_CRIT_C[n_vars - 2]] if trend == "c" and 2 <= n_vars <= 6 else [float("nan")] * 3


def za_p(stat: float, regression: str) -> float:
    return float(np.interp(stat, ZA[regression], ZA_PERCENT)) / 100
