"""Granger causality and unit-root tests per key.

Spark sums the cross products of the lag columns (one row of sufficient statistics per key and lag);
only those tiny matrices reach Python, where each is solved on its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from panelmill.operators.panel import DATE, KEY, by_key

# 5 % points of the unit-root test with constant, and of chi-square with one degree.
ADF_CRITICAL, CHI2_1 = -2.86, 3.841459


def cross_products(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """n and the flattened upper triangle of X'X (constant first) per key."""
    cols = [F.lit(1.0), *[F.col(c) for c in names]]
    sums = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i, len(cols))]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("xx"))


def _square(flat, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = flat
    return m + np.triu(m, 1).T


def _ssr(m: np.ndarray, target: int, regressors: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Residual sum of squares, coefficients and inverse normal matrix of target on regressors."""
    a = m[np.ix_(regressors, regressors)]
    inv = np.linalg.pinv(a)
    beta = inv @ m[regressors, target]
    return float(m[target, target] - m[target, regressors] @ beta), beta, inv


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square with k degrees > x), closed form for integer k."""
    if x <= 0:
        return 1.0
    h = x / 2
    if k % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, k // 2):
            term *= h / i
            total += term
        return math.exp(-h) * total
    total = math.erfc(math.sqrt(h))
    term = math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= h / (i + 0.5)
    return total


def _centred(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Subtract the key's mean: same tests, better-conditioned sums."""
    w = Window.partitionBy(key)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def granger_lag1(df: DataFrame, cause: str, effect: str, key: str = KEY, order: str = DATE) -> DataFrame:
    """Chi-square form for one lag, in closed form from variances and covariances."""
    w = by_key(key, order)
    d = df.select(key, F.col(effect).alias("y"), F.lag(effect).over(w).alias("a"), F.lag(cause).over(w).alias("b")).filter("b IS NOT NULL")
    m = d.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("y").alias("yy"), F.var_pop("a").alias("aa"), F.var_pop("b").alias("bb"),
        F.covar_pop("y", "a").alias("ya"), F.covar_pop("y", "b").alias("yb"), F.covar_pop("a", "b").alias("ab"),
    )
    restricted = F.expr("yy - try_divide(ya * ya, aa)")
    full = F.expr("yy - try_divide(ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa, aa * bb - ab * ab)")
    chi2 = F.try_divide(F.col("n") * (restricted - full), full)
    return m.select(key, "n", chi2.alias("chi2"), F.coalesce(chi2 > CHI2_1, F.lit(False)).alias("is_significant"))


def granger(
    df: DataFrame, cause: str, effect: str, max_lag: int = 5, key: str = KEY, order: str = DATE,
    make_stationary: bool = False, shrink_lag: bool = False,
) -> DataFrame:
    """Does `cause` help to predict `effect`: smallest p over the lags 1..max_lag, first on ties.

    Needs 3 max_lag + 2 rows; `shrink_lag` reduces the lags to (rows - 4) / 3 instead.
    """
    base = df.select(key, order, F.col(cause).alias("x"), F.col(effect).alias("y")).dropna()
    if make_stationary:
        base = differenced(differenced(base, "x", key, order), "y", key, order).dropna()
    base = _centred(base, ["x", "y"], key).withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
    w = by_key(key, order)
    lagged = base.select(
        key, "rows", "y", *[F.lag("y", k).over(w).alias(f"y{k}") for k in range(1, max_lag + 1)],
        *[F.lag("x", k).over(w).alias(f"x{k}") for k in range(1, max_lag + 1)],
    )
    lag_no = F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag")
    names = ["y", *[f"y{k}" for k in range(1, max_lag + 1)], *[f"x{k}" for k in range(1, max_lag + 1)]]
    per_lag = lagged.select(key, "rows", *names, lag_no)
    # a test of L lags uses the rows that have L lags; the unused lags count as 0
    usable = F.array(*[F.col(f"y{k}").isNotNull() for k in range(1, max_lag + 1)])
    per_lag = per_lag.filter(F.element_at(usable, F.col("lag")))
    for k in range(1, max_lag + 1):
        for c in (f"y{k}", f"x{k}"):
            per_lag = per_lag.withColumn(c, F.when(F.col("lag") >= k, F.col(c)).otherwise(0.0))
    stats = cross_products(per_lag, names, [key, "rows", "lag"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = int(pdf["rows"].iloc[0])
        limit = min(max_lag, (rows - 4) // 3) if shrink_lag else (max_lag if rows >= 3 * max_lag + 2 else 0)
        best_p, best = 1.0, -1
        for _, r in pdf.sort_values("lag").iterrows():
            lag = int(r["lag"])
            if lag > limit:
                continue
            m = _square(r["xx"], 2 + 2 * max_lag)
            own = [0, *range(2, 2 + lag)]
            both = own + list(range(2 + max_lag, 2 + max_lag + lag))
            restricted, full = _ssr(m, 1, own)[0], _ssr(m, 1, both)[0]
            if full <= 0:
                continue
            p = chi2_tail(r["n"] * (restricted - full) / full, lag)
            if p < best_p:
                best_p, best = p, lag
        return pd.DataFrame(
            {key: [pdf[key].iloc[0]], "sample_size": [rows], "best_lag": [best], "min_p_value": [best_p], "is_significant": [best_p < 0.05]}
        )

    kind = dict(df.dtypes)[key]
    # groups hold one row per lag
    return stats.groupBy(key).applyInPandas(solve, f"{key} {kind}, sample_size long, best_lag long, min_p_value double, is_significant boolean")


def adf(df: DataFrame, column: str, lags: int = 1, key: str = KEY, order: str = DATE) -> DataFrame:
    """Unit-root t statistic with constant and `lags` lagged differences; stationary below the 5 % point."""
    w = by_key(key, order)
    base = _centred(df.select(key, order, F.col(column).alias("v")).dropna(), ["v"], key)
    base = base.withColumn("d", F.col("v") - F.lag("v").over(w)).withColumn("l", F.lag("v").over(w))
    names = ["d", "l", *[f"d{k}" for k in range(1, lags + 1)]]
    base = base.select(key, "d", "l", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)]).dropna()
    stats = cross_products(base, names, [key])
    kind = dict(df.dtypes)[key]

    def solve(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                m, regs = _square(r["xx"], len(names) + 1), [0, *range(2, len(names) + 1)]
                ssr, beta, inv = _ssr(m, 1, regs)
                free = r["n"] - len(regs)
                t = beta[1] / math.sqrt(ssr / free * inv[1, 1]) if free > 0 and ssr > 0 and inv[1, 1] > 0 else None
                out.append((r[key], int(r["n"]), t, bool(t is not None and t < ADF_CRITICAL)))
            yield pd.DataFrame(out, columns=[key, "n", "t_stat", "is_stationary"])

    return stats.mapInPandas(solve, f"{key} {kind}, n long, t_stat double, is_stationary boolean")


def difference_order(df: DataFrame, column: str, key: str = KEY, order: str = DATE) -> DataFrame:
    """0, 1 or 2 differences per key: none when stationary, one when the first difference is, else two."""
    w = by_key(key, order)
    first = df.select(key, order, (F.col(column) - F.lag(column).over(w)).alias("d")).dropna()
    a = adf(df, column, key=key, order=order).select(key, F.col("t_stat").alias("t_level"), F.col("is_stationary").alias("s0"))
    b = adf(first, "d", key=key, order=order).select(key, F.col("t_stat").alias("t_diff"), F.col("is_stationary").alias("s1"))
    times = F.when(F.col("s0"), 0).when(F.col("s1"), 1).otherwise(2)
    return a.join(b, key, "left").select(key, "t_level", "t_diff", times.cast("long").alias("n_diff"))


def stationarity(df: DataFrame, column: str, key: str = KEY, order: str = DATE) -> DataFrame:
    return difference_order(df, column, key, order)


def differenced(df: DataFrame, column: str, key: str = KEY, order: str = DATE) -> DataFrame:
    """The column differenced as often as its key needs; the rows lost become null."""
    w = by_key(key, order)
    times = difference_order(df, column, key, order).select(key, "n_diff")
    out = df.withColumn("_d1", F.col(column) - F.lag(column).over(w))
    out = out.withColumn("_d2", F.col("_d1") - F.lag("_d1").over(w)).join(times, key)
    value = F.when(F.col("n_diff") == 0, F.col(column)).when(F.col("n_diff") == 1, F.col("_d1")).otherwise(F.col("_d2"))
    return out.withColumn(column, value).drop("_d1", "_d2", "n_diff")
