"""Aggregate statistics: per key, per column and per pair of columns, each in one pass.

Column lists are fixed by the caller, so "one row per column" results are one aggregate row that is
unpivoted; nothing is collected.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelmill.functions.columns import ColumnLike, col, ratio, snap, zero_if_null
from panelmill.operators.panel import DATE, KEY, by_key


def unpivot(df: DataFrame, names: list[str], prefix: str, label: str, value: str, ids: list[str] | None = None) -> DataFrame:
    """One row per name from columns `<prefix><name>`."""
    entries = F.array(*[F.struct(F.lit(n).alias(label), F.col(f"{prefix}{n}").alias(value)) for n in names])
    return df.select(*(ids or []), F.explode(entries).alias("_e")).select(*(ids or []), "_e.*")


# ------------------------------------------------------------------ counts, shares


def value_distribution(df: DataFrame, c: str) -> DataFrame:
    """Count and percent of each value; the total is a scalar subquery over the counts."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", snap(F.col("n").cast("double") / total * 100, 6))


def table_profile(df: DataFrame, key: str = KEY, order: str = DATE, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(key) if approximate else F.countDistinct(key)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_keys"), F.min(order).alias("first"), F.max(order).alias("last"))


def last_date_per_key(df: DataFrame, key: str = KEY, order: str = DATE) -> DataFrame:
    return df.groupBy(key).agg(F.max(order).alias("last"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column and in total ('*')."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns])
    total = sum((F.col(f"n_{c}") for c in columns[1:]), F.col(f"n_{columns[0]}"))
    return unpivot(one.withColumn("n_*", total), [*columns, "*"], "n_", "column", "n_null")


def duplicate_count(df: DataFrame, key: str, valid: Column) -> DataFrame:
    return df.agg(
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_invalid"),
        (F.count_if(valid) - F.countDistinct(F.when(valid, F.col(key)))).alias("n_duplicate"),
    )


def all_zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.sum(F.abs(F.col(c).cast("double"))).alias(f"s_{c}") for c in columns])
    return unpivot(one, columns, "s_", "column", "total").filter("total = 0").select("column")


def class_balance(df: DataFrame, target: str, lo: float = 0.1, hi: float = 0.9, key: str = KEY) -> DataFrame:
    """Positive rate overall ('*') and per key in one rollup; ok inside [lo, hi]."""
    rate = F.avg(F.col(target))
    out = df.rollup(key).agg(
        F.count(F.lit(1)).alias("n"), snap(rate, 6).alias("positive_rate"), rate.between(lo, hi).alias("balanced")
    )
    return out.withColumn(key, F.coalesce(key, F.lit("*")))


def key_health(df: DataFrame, min_rows: int = 1000, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("healthy", F.col("n_rows") >= min_rows)


def positive_rate(df: DataFrame, target: str, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.avg(target).alias("positive_rate"))


# ------------------------------------------------------------------- correlations


def _moments(batches, pairs: list[tuple[int, int]], k: int):
    """Per column pair the count, means and centred sums of the rows where both are present, of all batches of a task."""
    zero = lambda: np.zeros((k, k))
    n, mean, square, cross, bad = zero(), zero(), zero(), zero(), zero()  # mean[a, b]: of a where b is present
    low, high = zero() + np.inf, zero() - np.inf
    for batch in batches:
        x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        held = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        odd = held & ~np.isfinite(x)
        held_f, at = held.astype(float), (held & ~odd).argmax(axis=0)
        first = np.where((held & ~odd).any(axis=0), x[at, np.arange(k)], 0.0)
        # a constant column is exactly 0 after this
        with np.errstate(invalid="ignore"):
            d = np.where(held & ~odd, x - first, 0.0)
        middle = d.sum(axis=0) / np.maximum(1, held.sum(axis=0))
        d = np.where(held & ~odd, d - middle, 0.0)
        m = held_f.T @ held_f
        some = np.maximum(m, 1)
        total = d.T @ held_f
        own = (first + middle)[:, None] + total / some
        own_square, own_cross = (d * d).T @ held_f - total * total / some, d.T @ d - total * total.T / some
        for b in range(k):
            both = (held & ~odd) & held[:, b : b + 1]
            low[:, b] = np.minimum(low[:, b], np.where(both, x, np.inf).min(axis=0))
            high[:, b] = np.maximum(high[:, b], np.where(both, x, -np.inf).max(axis=0))
        wrong = odd.astype(float).T @ held_f
        move, share = np.where((n > 0) & (m > 0), own - mean, 0.0), n * m / np.maximum(n + m, 1)
        mean = np.where(n > 0, mean + move * m / np.maximum(n + m, 1), own)
        square, cross, n, bad = square + own_square + move * move * share, cross + own_cross + move * move.T * share, n + m, bad + wrong + wrong.T
    rows = [(i, n[a, b], mean[a, b], mean[b, a], square[a, b], square[b, a], cross[a, b], bad[a, b], low[a, b], high[a, b], low[b, a], high[b, a]) for i, (a, b) in enumerate(pairs)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=MOMENTS)


MOMENTS = ["pair", "n", "ma", "mb", "saa", "sbb", "sab", "bad", "la", "ha", "lb", "hb"]


def _merged(table: pa.Table) -> pa.Table:
    """(pair, corr) of one pair from its tasks' moments; none for no row or one, or where a column is constant."""
    n, ma, mb, saa, sbb, sab, bad = 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    for row in sorted(zip(*[table[c].to_pylist() for c in MOMENTS[1:8]], strict=True)):
        if row[0]:
            total, da, db = n + row[0], (row[1] - ma if n else 0.0), (row[2] - mb if n else 0.0)
            share = n * row[0] / total
            ma, mb = (ma + da * row[0] / total, mb + db * row[0] / total) if n else row[1:3]
            saa, sbb, sab = saa + row[3] + da * da * share, sbb + row[4] + db * db * share, sab + row[5] + da * db * share
            n, bad = total, bad + row[6]
    least, most = (lambda c: min(table[c].to_pylist())), (lambda c: max(table[c].to_pylist()))
    varied = least("la") < most("ha") and least("lb") < most("hb") and saa > 0 and sbb > 0
    corr = math.nan if bad and n > 1 else sab / math.sqrt(saa) / math.sqrt(sbb) if varied else None
    return pa.table({"pair": pa.array([table["pair"][0].as_py()], pa.int64()), "corr": pa.array([corr], pa.float64())})


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """All column pairs of one pass: (feature_a, feature_b, corr).

    Each task hands on one row of moments per pair; as many `corr` aggregates are more code than the engine compiles.
    """
    places = list(combinations(range(len(columns)), 2))
    fields = ", ".join(f"{c} {'long' if c == 'pair' else 'double'}" for c in MOMENTS)
    values = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    moments = values.mapInArrow(lambda batches: _moments(batches, places, len(columns)), fields)
    found = moments.groupBy("pair").applyInArrow(_merged, "pair long, corr double")
    names = [(i, columns[a], columns[b]) for i, (a, b) in enumerate(places)]
    listed = df.sparkSession.createDataFrame(names, "pair long, feature_a string, feature_b string")
    return listed.join(F.broadcast(found), "pair", "left").drop("pair")  # at most one row per listed pair


def correlated_pairs(df: DataFrame, columns: list[str], threshold: float = 0.85) -> DataFrame:
    pairs = correlation_pairs(df, columns).withColumn("abs_corr", F.abs("corr"))
    return pairs.filter(F.col("abs_corr") > threshold).select("feature_a", "feature_b", "abs_corr").orderBy(F.desc("abs_corr"), "feature_a", "feature_b")


def target_correlation(df: DataFrame, columns: list[str], target: str, leak: float = 0.95) -> DataFrame:
    one = df.agg(*[F.corr(c, target).alias(f"c_{c}") for c in columns])
    return unpivot(one, columns, "c_", "feature", "corr").withColumn("leaks", F.coalesce(F.abs("corr") > leak, F.lit(False)))


def separation_audit(df: DataFrame, a: str, b: str, fail: float = 0.999, warn: float = 0.9) -> DataFrame:
    r = F.abs("corr")
    return df.agg(F.corr(a, b).alias("corr")).withColumn("status", F.when(r > fail, "FAIL").when(r > warn, "WARN").otherwise("PASS"))


def mutual_information(df: DataFrame, columns: list[str], target: str, bins: int = 10) -> DataFrame:
    """MI (nats) of each binned feature with the target, from one contingency table.

    Bins are equal-width between the column's minimum and maximum, so bounds come from one aggregate
    and the table has at most columns x bins x classes rows.
    """
    long = df.select(
        F.col(target).cast("long").alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_e"),
    ).select("y", "_e.*")
    bounds = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"b_{c}") for c in columns])
    bounds = unpivot(bounds, columns, "b_", "feature", "b").select("feature", "b.lo", "b.hi")
    # one row per listed column: the column list is the bound
    placed = long.join(F.broadcast(bounds), "feature").filter("x IS NOT NULL")
    width = F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo"))
    cell = F.coalesce(F.least(F.floor(snap(width, 9) * bins), F.lit(bins - 1)), F.lit(0))
    table = placed.groupBy("feature", cell.alias("cell"), "y").agg(F.count(F.lit(1)).cast("double").alias("n"))
    f = Window.partitionBy("feature")
    n, nx, ny = F.sum("n").over(f), F.sum("n").over(Window.partitionBy("feature", "cell")), F.sum("n").over(Window.partitionBy("feature", "y"))
    parts = table.select("feature", (F.col("n") / n * F.ln(F.col("n") * n / (nx * ny))).alias("part"))
    return parts.groupBy("feature").agg(F.sum("part").alias("importance"))


# ------------------------------------------------------------- ranges, thresholds


def range_audit(df: DataFrame, columns: list[str], lo: float, hi: float) -> DataFrame:
    """min / max / mean / deviation per column; suspicious outside [lo, hi]."""
    one = df.agg(
        *[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(f"r_{c}") for c in columns]
    )
    out = unpivot(one, columns, "r_", "column", "r").select("column", "r.*")
    return out.withColumn("suspicious", (F.col("min") < lo) | (F.col("max") > hi))


def sparsity_audit(df: DataFrame, c: str, eps: float = 1e-4, want: float = 0.95) -> DataFrame:
    near = F.abs(F.col(c)) < eps
    return df.agg(
        F.count_if(near).alias("n_zero"), F.count_if(~near).alias("n_spike"), F.avg(F.when(near, 1.0).otherwise(0.0)).alias("zero_share")
    ).withColumn("passed", F.col("zero_share") >= want)


def unit_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.max(c).cast("double").alias(f"m_{c}") for c in columns])
    m = F.col("max")
    return unpivot(one, columns, "m_", "column", "max").withColumn(
        "scale", F.when(m <= 1, "decimal").when(m <= 100, "percentage").otherwise("unknown")
    )


def percentile_threshold(df: DataFrame, p: str, share: float = 0.40, key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(F.percentile(p, F.lit(share)).alias("threshold"))


def fixed_bins(df: DataFrame, c: str, edges: list[float]) -> DataFrame:
    """Counts in [lo, hi) for neighbouring edges; empty bins included."""
    spans = list(zip(edges, edges[1:]))
    one = df.agg(*[F.count_if((F.col(c) >= lo) & (F.col(c) < hi)).alias(f"n_{i}") for i, (lo, hi) in enumerate(spans)])
    rows = F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.col(f"n_{i}").alias("n")) for i, (lo, hi) in enumerate(spans)])
    return one.select(F.explode(rows).alias("_e")).select("_e.*")


# ------------------------------------------------------------- forecast evaluation


def confusion(y: str, yhat: str) -> dict[str, Column]:
    hit = lambda a, b: F.count_if((F.col(y) == a) & (F.col(yhat) == b))
    return {"tp": hit(1, 1), "fp": hit(0, 1), "fn": hit(1, 0), "tn": hit(0, 0)}


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, accuracy from counts; an empty denominator gives 0."""
    z = lambda a, b: zero_if_null(ratio(a, b))
    return {"precision": z(tp, tp + fp), "recall": z(tp, tp + fn), "f1": z(2 * tp, 2 * tp + fp + fn), "accuracy": z(tp + tn, tp + fp + fn + tn)}


def binary_metrics(df: DataFrame, y: str, yhat: str, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in confusion(y, yhat).items()])
    return counts.withColumns(metric_columns(*[F.col(n) for n in ("tp", "fp", "fn", "tn")]))


def roc_auc(df: DataFrame, y: str, p: str, *keys: str) -> DataFrame:
    """Rank-sum AUC with ties averaged; null when a key has one class only.

    Equal scores are counted before the window, so it runs over the distinct scores of a key.
    """
    cells = df.groupBy(*keys, p).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).alias("pos"))
    w = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0))
    ranked = cells.withColumn("rank_sum", F.col("pos") * (below + (F.col("n") + 1) / 2.0))
    sums = ranked.groupBy(*keys).agg(F.sum("rank_sum").alias("r"), F.sum("pos").alias("p1"), (F.sum("n") - F.sum("pos")).alias("p0"))
    auc = F.try_divide(F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2.0, (F.col("p1") * F.col("p0")).cast("double"))
    return sums.select(*keys, auc.alias("auc"))


def diebold_mariano(df: DataFrame, loss_a: Column, loss_b: Column, h: int = 1, key: str = KEY, order: str = DATE) -> DataFrame:
    """DM statistic per key: mean loss difference over its standard error; h > 1 adds autocovariances.

    Null below 10 rows or without variance. Positive means b is better.
    """
    d = df.select(key, order, (loss_a - loss_b).alias("d"))
    for k in range(1, h):
        d = d.withColumn(f"d{k}", F.lag("d", k).over(by_key(key, order)))
    aggs = [F.count("d").alias("n"), F.avg("d").alias("d_bar"), F.var_samp("d").alias("g0")]
    aggs += [F.covar_samp(F.when(F.col(f"d{k}").isNotNull(), F.col("d")), f"d{k}").alias(f"g{k}") for k in range(1, h)]
    out = d.groupBy(key).agg(*aggs)
    var = F.col("g0")
    for k in range(1, h):
        var = var + F.coalesce(F.lit(2 * (1 - k / h)) * F.col(f"g{k}"), F.lit(0.0))
    out = out.withColumn("v", var / F.col("n"))
    ok = (F.col("n") >= 10) & (F.col("v") > 0)
    return out.select(key, "n", F.when(ok, F.col("d_bar") / F.sqrt("v")).alias("dm"))


def _student_tail(t: float, v: int) -> float:
    """P(|T| > t) for an integer number of degrees, by the finite trigonometric series."""
    theta = math.atan2(abs(t), math.sqrt(v))
    cos2 = math.cos(theta) ** 2
    if v % 2:
        total, term = 0.0, math.cos(theta)
        for i in range(1, (v - 1) // 2 + 1):
            total += term
            term *= cos2 * (2 * i) / (2 * i + 1)
        inside = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        total, term = 0.0, 1.0
        for i in range(1, v // 2 + 1):
            total += term
            term *= cos2 * (2 * i - 1) / (2 * i)
        inside = math.sin(theta) * total
    return max(0.0, 1 - inside)


def p_value_t(t: ColumnLike, df: ColumnLike) -> Column:
    """Two-sided p-value; applied to one row per key, never to the panel."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else _student_tail(float(a), int(b)) for a, b in zip(t, df)], dtype="float64")

    return tail(col(t), col(df))


# The score of an invalid Sharpe ratio, the fewest trades, trading days of a year.
INVALID_SHARPE, MIN_TRADES, TRADING_DAYS = -999.0, 10, 252


def sharpe(n: Column, mean: Column, std: Column, periods: int = TRADING_DAYS) -> Column:
    ok = (n >= MIN_TRADES) & (snap(std, 9) > 0)
    return F.when(ok, mean / std * F.lit(math.sqrt(periods))).otherwise(F.lit(INVALID_SHARPE))


def annualized_sharpe(df: DataFrame, r: str, *keys: str, periods: int = TRADING_DAYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(r).alias("n"), sharpe(F.count(r), F.avg(r), F.stddev_pop(r), periods).alias("sharpe"))


def cagr_column(r: Column, periods: int = TRADING_DAYS) -> Column:
    """Compound annual growth; total loss gives -1, no rows 0."""
    growth = F.exp(F.sum(F.when(1 + r > 0, F.ln(1 + r))) * periods / F.count(r)) - 1
    return F.when(F.count(r) == 0, 0.0).when(F.min(1 + r) <= 0, -1.0).otherwise(growth)


def cagr(df: DataFrame, r: str, *keys: str, periods: int = TRADING_DAYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(r).alias("n"), cagr_column(F.col(r), periods).alias("cagr"))


def win_rate_column(r: Column) -> Column:
    return zero_if_null(F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)))


def win_rate(df: DataFrame, r: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(win_rate_column(F.col(r)).alias("win_rate"))


def sharpe_threshold_sweep(df: DataFrame, p: str, r: str, lo: int = 40, hi: int = 90, default: float = 0.5, key: str = KEY) -> DataFrame:
    """Score threshold with the best Sharpe among those with enough trades and a win rate of a half.

    A row counts for every threshold up to its score. Instead of repeating rows per threshold, rows are
    summed by score step (map-side) and the steps are accumulated from the top: 51 rows per key.
    """
    step = F.least(F.floor(snap(F.col(p) * 100, 6)), F.lit(hi)).cast("long")
    # rows below the grid or without a return only keep their key in the result
    cell = F.when((step >= lo) & F.col(r).isNotNull(), step)
    cells = df.select(key, cell.alias("t"), F.when(cell.isNotNull(), F.col(r)).alias("_r")).groupBy(key, "t").agg(
        F.count("_r").alias("n"), F.sum("_r").alias("s"), F.sum(F.col("_r") * F.col("_r")).alias("ss"), F.count_if(F.col("_r") > 0).alias("w")
    )
    down = Window.partitionBy(key).orderBy(F.desc_nulls_last("t"))
    above = {c: F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, 0)) for c in ("n", "s", "ss", "w")}
    # a threshold without rows of its own selects the trades of the next higher one with rows and ties with it;
    # the lowest threshold of such a run follows the next lower step
    low = F.coalesce(F.lead("t").over(down) + 1, F.lit(lo))
    totals = cells.select(key, "t", low.alias("t_low"), *[v.alias(c) for c, v in above.items()])
    mean = F.try_divide(F.col("s"), F.col("n"))
    std = F.sqrt(F.greatest(F.try_divide(F.col("ss"), F.col("n")) - mean * mean, F.lit(0.0)))
    curve = totals.select(key, "t", "t_low", F.try_divide("w", "n").alias("win"), snap(sharpe(F.col("n"), mean, std), 6).alias("sharpe"))
    valid = F.col("t").isNotNull() & (F.col("sharpe") > INVALID_SHARPE) & (F.col("win") >= 0.5)
    best = curve.groupBy(key).agg(
        F.max(F.when(valid, F.struct(F.col("sharpe"), (-F.col("t_low")).alias("down")))).alias("b")
    )
    return best.select(key, F.coalesce(-F.col("b.down") / F.lit(100.0), F.lit(default)).alias("threshold"), F.col("b.sharpe").alias("best_sharpe"))


# ------------------------------------------------------------------ result tables


def pivot_mean(df: DataFrame, rows: str, cols: str, values: list, value: str) -> DataFrame:
    return df.groupBy(rows).pivot(cols, values).agg(F.avg(value))


def best_per_key(df: DataFrame, key: str, metric: str, tie: str) -> DataFrame:
    """Row with the largest metric per key, the smallest `tie` on equal metrics."""
    w = Window.partitionBy(key).orderBy(F.desc(metric), tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def category_summary(importance: DataFrame, category: Column) -> DataFrame:
    return importance.groupBy(category.alias("category")).agg(F.avg("importance").alias("mean_importance"), F.count(F.lit(1)).alias("n_features"))


def metric_summary(report: DataFrame, metrics: list[str], flags: list[str]) -> DataFrame:
    aggs = [F.struct(F.avg(m).alias("mean"), F.stddev_samp(m).alias("std")).alias(f"m_{m}") for m in metrics]
    aggs += [F.struct(F.avg(F.when(F.col(f), 1.0).otherwise(0.0)).alias("mean"), F.lit(None).cast("double").alias("std")).alias(f"m_{f}") for f in flags]
    return unpivot(report.agg(*aggs), [*metrics, *flags], "m_", "metric", "v").select("metric", "v.*")
