"""Cross-product moments in one aggregation, small algebra on the result.

``moments`` sums all products of some columns by key: partial sums are made where the rows are, so what is shuffled is
one short array for each key and task. ``solved`` gives each key's matrix to a numpy function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import RESULT, flatten


def products(columns: Sequence[Column]) -> Column:
    """An array of the sums of products i <= j."""
    return F.array(*(F.sum(columns[i] * columns[j]) for i in range(len(columns)) for j in range(i, len(columns))))


def square(flat: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    at = np.triu_indices(k)
    out[at] = flat
    return out + np.triu(out, 1).T


def moments(df: DataFrame, columns: Sequence[str | Column], key: Sequence[str] = ()) -> DataFrame:
    """(key…, n, m): the number of rows and the flat upper triangle of products of the columns."""
    cols = [F.col(c).cast("double") if isinstance(c, str) else c for c in columns]
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), products(cols).alias("m"))


def solved(df: DataFrame, key: Sequence[str], body: Callable[..., dict], extra: Sequence[str] = (), **options) -> DataFrame:
    """``body(n, m, *extra, **options)`` of each row of a table of moments, as result rows."""
    key = list(key)

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            parts = []
            for row in frame.to_dict("records"):
                rows = flatten(body(int(row["n"]), np.array(row["m"], float), *(np.array(row[c], float) for c in extra), **options))
                part = pd.DataFrame(rows, columns=["field", "i", "j", "k", "value", "note"])
                for at, c in enumerate(key):
                    part.insert(at, c, row[c])
                parts.append(part)
            if parts:
                out = pd.concat(parts)
                for c in ("i", "j", "k"):
                    out[c] = out[c].astype("Int32")
                yield out

    kinds = dict(df.dtypes)
    return df.select(*key, "n", "m", *extra).mapInPandas(run, "".join(f"`{c}` {kinds[c]}, " for c in key) + RESULT)


def coefficients(df: DataFrame, y: str, xs: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """(key…, n, m, beta): moments of [xs, y] and the least-squares coefficients."""
    k = len(xs)
    m = moments(df, [*xs, y], key)

    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series) -> pd.Series:
        out = []
        for one in flat:
            a = square(one, k + 1)
            out.append(np.linalg.lstsq(a[:k, :k], a[:k, k], rcond=None)[0].tolist())
        return pd.Series(out)

    return m.withColumn("beta", solve("m"))
