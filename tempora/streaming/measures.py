"""Streams: realized measures of time windows, and filters that carry a state from row to row."""

from __future__ import annotations

import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def realized_variance(stream: DataFrame, time: str, returns: str, key: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, key, n, rv, rq) of each tumbling window; rows later than ``late`` are dropped by the watermark."""
    r = F.col(returns)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.window(time, window), key)
        .agg(F.count(r).alias("n"), F.sum(r * r).alias("rv"), (F.count(r) / 3 * F.sum(F.pow(r, F.lit(4.0)))).alias("rq"))
    )


def local_level_filter(stream: DataFrame, time: str, y: str, key: str, sigma2_eps: float, sigma2_eta: float) -> DataFrame:
    """(key, time, level, variance, loglik): the exact-diffuse local-level filter of each key, one small state a key.

    Rows of a micro-batch are taken in the order of their times; the state is the level, its variance and the log likelihood."""

    def step(group: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterable[pd.DataFrame]:
        level, var, ll = state.get if state.exists else (0.0, -1.0, 0.0)
        rows = pd.concat(list(frames)).sort_values(time)
        out = []
        for at, v in zip(rows[time], rows[y], strict=True):
            if var >= 0:
                var += sigma2_eta
            if v == v:
                if var < 0:
                    level, var = v, sigma2_eps
                    ll -= 0.5 * math.log(2 * math.pi)
                else:
                    f = var + sigma2_eps
                    ll -= 0.5 * (math.log(2 * math.pi * f) + (v - level) ** 2 / f)
                    level, var = level + var / f * (v - level), var - var * var / f
            out.append((group[0], at, level, var, ll))
        state.update((level, var, ll))
        yield pd.DataFrame(out, columns=[key, time, "level", "variance", "loglik"])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, level double, variance double, loglik double", "level double, variance double, loglik double", "append", "NoTimeout"
    )
