"""Chronological splits, walk-forward folds and train-only statistics.

Positions count rows per ticker in date order; shares are multiplied as doubles and floored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelmill.functions.columns import col, snap
from panelmill.operators.panel import DATE, KEY, by_key


def with_positions(df: DataFrame, key: str = KEY, order: str = DATE) -> DataFrame:
    """row_no (from 1) and n_rows per key."""
    return df.withColumns(
        {
            "row_no": F.row_number().over(by_key(key, order)).cast("long"),
            "n_rows": F.count(F.lit(1)).over(Window.partitionBy(key)),
        }
    )


def _share(share: float) -> Column:
    return F.floor(F.col("n_rows").cast("double") * F.lit(float(share)))


def time_split(df: DataFrame, train: float = 0.8, key: str = KEY) -> DataFrame:
    staged = with_positions(df, key)
    return staged.withColumn("split", F.when(F.col("row_no") <= _share(train), "train").otherwise("test"))


def embargo_split(df: DataFrame, train: float = 0.70, val: float = 0.10, gap: int = 5, key: str = KEY) -> DataFrame:
    """train | gap | val | gap | test; gap rows get a null label."""
    staged = with_positions(df, key)
    a = _share(train)
    b = a + gap + _share(val)
    i = F.col("row_no")
    label = F.when(i <= a, "train").when(i <= a + gap, None).when(i <= b, "val").when(i <= b + gap, None).otherwise("test")
    return staged.withColumn("split", label)


def purged_split(df: DataFrame, train: float = 0.72, val: float = 0.08, gap: int = 5, key: str = KEY) -> DataFrame:
    """As the embargo split; where the gaps would leave no test rows, validation starts at the end of the training rows, keeps
    its end, and the test rows follow at once (very short keys have none)."""
    staged = with_positions(df, key)
    a, v = _share(train), _share(val)
    g = F.when(a + gap + v + gap >= F.col("n_rows"), 0).otherwise(gap)
    b = a + gap + v
    i = F.col("row_no")
    label = (
        F.when(i <= a, "train").when(i <= a + g, None).when(i <= b, "val").when(i <= b + g, None).otherwise("test")
    )
    return staged.withColumn("split", label)


def fold_roles(window: int, test: int = 63, purge: int = 2, embargo: int = 2) -> Column:
    """Array of (fold, role) that a row with row_no and n_rows belongs to.

    Test block f covers positions [start_f, start_f + test) with start_f = window + gap + f * test;
    its training rows are the `window` rows that end `gap` rows earlier. So a row is in at most one
    test block and in about window / test training blocks: two bounded sequences, no range join.
    """
    first = window + purge + embargo
    pos = F.col("row_no") - 1
    last_fold = F.floor((F.col("n_rows") - first - test) / test)
    test_fold = F.floor((pos - first) / test)
    in_test = (pos >= first) & (test_fold <= last_fold)
    low = F.greatest(F.lit(0), F.ceil((pos - window + 1) / test)).cast("long")
    high = F.least(F.floor(pos / test), last_fold).cast("long")
    tests = F.when(in_test, F.array(F.struct(test_fold.cast("long").alias("fold"), F.lit("test").alias("role"))))
    trains = F.when(
        (last_fold >= 0) & (low <= high),
        F.transform(F.sequence(low, high), lambda f: F.struct(f.alias("fold"), F.lit("train").alias("role"))),
    )
    return F.concat(F.coalesce(tests, F.array()), F.coalesce(trains, F.array()))


def walk_forward_folds(df: DataFrame, windows: dict[str, int], test: int = 63, purge: int = 2, embargo: int = 2, key: str = KEY, order: str = DATE) -> DataFrame:
    """Every row once per (window, fold, role) it belongs to; the rows carry their columns, so nothing is joined back."""
    staged = with_positions(df, key, order)

    def labelled(name: str, size: int) -> Column:
        label = lambda r: F.struct(F.lit(name).alias("window"), r["fold"].alias("fold"), r["role"].alias("role"))
        return F.transform(fold_roles(size, test, purge, embargo), label)

    per_window = [labelled(name, size) for name, size in windows.items()]
    return staged.select("*", F.explode(F.concat(*per_window)).alias("_r")).select(*df.columns, "row_no", "_r.window", "_r.fold", "_r.role")


def zscore_expr(c: str, train: Column, key: str = KEY, population: bool = False) -> Column:
    """(x - mean) / sigma with train-only statistics of the key; zero sigma is 1; nulls become 0."""
    w = Window.partitionBy(key)
    x = F.when(train, F.col(c))
    std = F.stddev_pop if population else F.stddev_samp
    sigma = snap(std(x).over(w), 9)
    sigma = F.when(sigma == 0, 1.0).otherwise(sigma)
    return F.coalesce(snap((F.col(c) - F.avg(x).over(w)) / sigma, 9), F.lit(0.0))


def standardise(df: DataFrame, columns: list[str], train: Column, population: bool = False, key: str = KEY) -> DataFrame:
    return df.withColumns({c: zscore_expr(c, train, key, population) for c in columns})


def fit_zscore(df: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """Mean and sample deviation (0 -> 1) of the rows given, which must be training rows."""
    aggs = []
    for c in columns:
        sd = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"{c}_mu"), F.when(snap(sd, 9) == 0, 1.0).otherwise(sd).alias(f"{c}_sigma")]
    return df.groupBy(key).agg(*aggs)


def class_weights(df: DataFrame, target: str, key: str = KEY) -> DataFrame:
    """n / (2 n_class) per key and class."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key)).cast("double")
    k = F.sum(F.lit(1)).over(Window.partitionBy(key, target)).cast("double")
    return df.withColumn("weight", n / (2 * k))


def split_size_guard(df: DataFrame, total: int = 100, train: int = 50, val: int = 10, test: int = 20, key: str = KEY) -> DataFrame:
    """Keys whose splits are all large enough, with their sizes."""
    n = lambda s: F.count_if(F.col("split") == s)
    sizes = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), n("train").alias("n_train"), n("val").alias("n_val"), n("test").alias("n_test")
    )
    return sizes.filter(
        (F.col("n_rows") >= total) & (F.col("n_train") >= train) & (F.col("n_val") >= val) & (F.col("n_test") >= test)
    )


def fold_ranges(sizes: DataFrame, window: int, test: int = 63, purge: int = 2, embargo: int = 2, key: str = KEY) -> DataFrame:
    """One row per fold of each key: the half-open position range of its test block."""
    first = window + purge + embargo
    last = F.floor((F.col("n") - first - test) / test)
    folds = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long")))
    start = (F.lit(first) + F.col("fold") * test).cast("long")
    return sizes.select(key, F.explode(folds).alias("fold")).select(key, "fold", start.alias("test_start"), (start + test).alias("test_end"))
