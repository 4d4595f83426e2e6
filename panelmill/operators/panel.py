"""Panel operators: one row per (ticker, dt).

A panel holds at most one bar per ticker and calendar day, so a ticker's window
partition is bounded by the length of the calendar, however many rows the panel has.
All per-ticker operators share one window specification, so Spark plans one exchange
and one sort for a whole chain of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from panelmill.functions.columns import ColumnLike, col, flag, ratio, snap, zero_if_null

KEY, DATE = "ticker", "dt"


def by_key(key: str = KEY, order: str = DATE) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def by_date(order: str = DATE) -> WindowSpec:
    """Window over a date-level series: one row per calendar day, so one small partition."""
    return Window.orderBy(order)


def in_order(key: str | None = KEY, order: str = DATE) -> WindowSpec:
    return by_key(key, order) if key else by_date(order)


# --------------------------------------------------------------------------- joins

FIRST_DAY, LAST_DAY = "1900-01-01", "2299-12-31"


def per_day(series: DataFrame, *aggregates: Column, order: str = DATE) -> DataFrame:
    """Aggregate to one row per day, the form that `join_macro` may broadcast."""
    return series.groupBy(order).agg(*aggregates)


def join_macro(bars: DataFrame, macro: DataFrame, order: str = DATE) -> DataFrame:
    """Left join of a daily series on the date; keeps every bar, no shuffle of the bars."""
    return bars.join(_bounded(macro, order), order, "left")


def _bounded(series: DataFrame, order: str) -> DataFrame:
    """Broadcast a date-level series, with the bound enforced in the plan.

    A second row of a day or a day outside four centuries fails the job, so what is broadcast has at
    most 146,097 rows. A series grouped by day is already partitioned that way: no further shuffle.
    """
    day = F.when(
        F.col(order).between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), F.col(order)
    ).otherwise(F.raise_error(F.lit("date outside 1900-2299: series is not bounded")).cast("date"))
    values = [F.first(c).alias(c) for c in series.columns if c != order]
    grouped = series.groupBy(order).agg(F.count(F.lit(1)).alias("_n"), *values)
    single = F.when(F.col("_n") == 1, day).otherwise(F.raise_error(F.lit("more than one row per day")).cast("date"))
    return F.broadcast(grouped.withColumn(order, single).drop("_n"))


def merge_series(*series: DataFrame, order: str = DATE) -> DataFrame:
    """n-way full outer join on the date."""
    return reduce(lambda a, b: a.join(b, order, "full"), series)


def asof_macro(bars: DataFrame, series: DataFrame, order: str = DATE) -> DataFrame:
    """Latest known value of each series column at or before the bar's date.

    Fills along the distinct bar dates (one row per day) and joins back on equality,
    instead of a range join over the panel.
    """
    values = [c for c in series.columns if c != order]
    days = bars.select(order).distinct().withColumn("_bar", F.lit(True))
    w = by_date(order).rowsBetween(Window.unboundedPreceding, 0)
    timeline = days.join(series, order, "full").select(
        order, "_bar", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values]
    )
    return join_macro(bars, timeline.filter("_bar").drop("_bar"), order)


def effective_lookup(df: DataFrame, steps: list[tuple[str, float]], order: str = DATE, value: str = "rate") -> DataFrame:
    """Rate in force at each date, from a short list of (effective date, rate) settings.

    The list is configuration known to the driver, so it becomes one CASE expression: no join.
    """
    chain = None
    for day, rate in sorted(steps, reverse=True):
        hit = F.col(order) >= F.lit(day).cast("date")
        chain = F.when(hit, F.lit(rate)) if chain is None else chain.when(hit, F.lit(rate))
    return df.withColumn(value, chain)


def effective_join(df: DataFrame, steps: DataFrame, order: str = DATE, start: str = "eff_date") -> DataFrame:
    """The same lookup for a table of settings: as-of on the date level."""
    return asof_macro(df, steps.withColumnRenamed(start, order), order)


def align_series(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Inner join on the keys, rows with a null dropped."""
    return a.join(b, list(keys), "inner").dropna()


def only_new(df: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not in `existing`."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def restrict_to(df: DataFrame, keys: list[str], key: str = KEY) -> DataFrame:
    return df.filter(F.col(key).isin(list(keys)))


def after_high_water(new: DataFrame, existing: DataFrame, key: str = KEY, order: str = DATE) -> DataFrame:
    """Rows later than the key's newest date in `existing`; unseen keys pass whole."""
    mark = existing.groupBy(key).agg(F.max(order).alias("_mark"))
    joined = new.join(mark, key, "left")
    return joined.filter(F.col("_mark").isNull() | (F.col(order) > F.col("_mark"))).drop("_mark")


def date_key_grid(dates: DataFrame, keys: list[str], order: str = DATE, key: str = KEY) -> DataFrame:
    """Every distinct date with every key of a configured list; each date row expands itself."""
    listed = F.array(*[F.lit(k) for k in keys])
    return dates.select(order).distinct().select(order, F.explode(listed).alias(key))


def enrich_metadata(
    df: DataFrame, cache: DataFrame, fallback: DataFrame, columns: list[str], key: str = KEY, default: str = "N/A"
) -> DataFrame:
    """Fill each column from the cache, then the row itself, then the fallback table, then a default."""
    c = cache.select(key, *[F.col(x).alias(f"_c_{x}") for x in columns])
    f = fallback.select(key, *[F.col(x).alias(f"_f_{x}") for x in columns])
    joined = df.join(c, key, "left").join(f, key, "left")
    filled = [F.coalesce(f"_c_{x}", x, f"_f_{x}", F.lit(default)).alias(x) for x in columns]
    return joined.select(*[x for x in df.columns if x not in columns], *filled)


# ------------------------------------------------------------------- filters, keys


def drop_suspended(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("volume") > 0)


def clip_filter(df: DataFrame, column: str, lo: float, hi: float) -> DataFrame:
    return df.filter(F.col(column).between(lo, hi))


def drop_neutral(df: DataFrame, column: str = "ratio", margin: float = 0.001) -> DataFrame:
    return df.filter(~F.col(column).between(1 - margin, 1 + margin))


def eligible_keys(df: DataFrame, min_rows: int, key: str = KEY) -> DataFrame:
    """Rows of keys with at least `min_rows` rows; counted in the panel's own partitioning."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("_n", n).filter(F.col("_n") >= min_rows).drop("_n")


def select_available(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def feature_columns(df: DataFrame, exclude: list[str]) -> list[str]:
    numeric = {"double", "float", "bigint", "int", "smallint", "tinyint"}
    return [n for n, t in df.dtypes if t in numeric and n not in exclude]


def assert_no_forbidden(df: DataFrame, columns: list[str]) -> DataFrame:
    leaked = [c for c in columns if c in df.columns]
    if leaked:
        raise ValueError(f"forbidden columns present: {leaked}")
    return df


def assert_required(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def drop_last_per_key(df: DataFrame, key: str = KEY, order: str = DATE) -> DataFrame:
    return df.withColumn("_next", F.lead(order).over(by_key(key, order))).filter("_next IS NOT NULL").drop("_next")


def dedupe_keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The row with the largest load sequence per key, by map-side combined arg-max (no window, no hot group)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(sequence)).alias("_row"))
        .select(*[F.col(k) for k in keys], "_row.*")
        .select(*df.columns)
    )


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Union where a delta row replaces the base row of the same key."""
    both = base.withColumn("_seq", F.lit(0)).unionByName(delta.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    return dedupe_keep_last(both, keys, "_seq").drop("_seq")


def union_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


# ----------------------------------------------------------------- window features


def pct_change(c: ColumnLike, k: int, w: WindowSpec) -> Column:
    return ratio(c, F.lag(col(c), k).over(w)) - 1


def pct_change_padded(df: DataFrame, c: str, k: int, out: str, key: str | None = KEY, order: str = DATE) -> DataFrame:
    """pct_change of the forward-filled column (nulls are padded before dividing)."""
    w = in_order(key, order)
    staged = df.withColumn("_pad", fill_forward(c, key, order))
    return staged.withColumn(out, pct_change("_pad", k, w)).drop("_pad")


def log_return(c: ColumnLike, w: WindowSpec) -> Column:
    """ln(c / previous c); 0 on a key's first row."""
    r = ratio(c, F.lag(col(c), 1).over(w))
    return F.coalesce(F.when(r > 0, F.ln(r)), F.lit(0.0))


def rolling(agg, c: ColumnLike, n: int, min_periods: int, w: WindowSpec) -> Column:
    """`agg` over the last n rows, null with fewer than `min_periods` values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) >= min_periods, agg(col(c)).over(frame))


def rolling_mean(c: ColumnLike, n: int, min_periods: int, w: WindowSpec) -> Column:
    return rolling(F.avg, c, n, min_periods, w)


def volatility(c: ColumnLike, n: int, w: WindowSpec, min_periods: int | None = None) -> Column:
    return rolling(F.stddev_samp, c, n, max(3, n // 2) if min_periods is None else min_periods, w)


def volume_ratio(c: ColumnLike, n: int, min_periods: int, w: WindowSpec) -> Column:
    return ratio(c, rolling_mean(c, n, min_periods, w))


def price_vs_ma(c: ColumnLike, n: int, min_periods: int, w: WindowSpec) -> Column:
    return ratio(c, rolling_mean(c, n, min_periods, w)) - 1


def with_rsi(df: DataFrame, c: str, n: int, out: str, key: str = KEY, order: str = DATE) -> DataFrame:
    """Simple-mean RSI. The first delta counts as 0; no loss gives 100, no move at all null."""
    w = by_key(key, order)
    gain, loss = gain_and_loss(c, w)
    staged = df.withColumn("_gain", gain).withColumn("_loss", loss).withColumns(rsi_means("_gain", "_loss", n, w))
    return staged.withColumn(out, rsi(n)).drop("_gain", "_loss", "_up", "_down", "_seen")


def gain_and_loss(c: str, w: WindowSpec) -> tuple[Column, Column]:
    """What a row gains and loses on the one before; the first delta counts as 0."""
    delta = F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))
    return F.greatest(delta, F.lit(0.0)), F.greatest(-delta, F.lit(0.0))


def rsi_means(gain: str, loss: str, n: int, w: WindowSpec) -> dict[str, Column]:
    """What `rsi` reads, each frame computed once: mean gain and loss of the last n rows and their number."""
    frame = w.rowsBetween(-(n - 1), 0)
    return {"_up": F.avg(gain).over(frame), "_down": F.avg(loss).over(frame), "_seen": F.count(F.lit(1)).over(frame)}


def rsi(n: int) -> Column:
    """Simple-mean RSI of the staged means; no loss gives 100, no move at all null."""
    up, down = snap("_up", 9), snap("_down", 9)
    value = F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, F.lit(100.0))
    return F.when(F.col("_seen") >= n, value)


def fill_forward(c: ColumnLike, key: str | None = KEY, order: str = DATE) -> Column:
    return F.last(col(c), ignorenulls=True).over(in_order(key, order).rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(c: ColumnLike, key: str | None = KEY, order: str = DATE) -> Column:
    """Next value at or after the row, as a running frame over the reversed order: linear, not quadratic."""
    back = Window.partitionBy(key).orderBy(F.desc(order)) if key else Window.orderBy(F.desc(order))
    return F.last(col(c), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def fill_columns(df: DataFrame, columns: list[str], key: str | None = KEY, order: str = DATE, backfill: bool = False) -> DataFrame:
    """Forward fill per key. `backfill=True` also fills the head from the future, as look-ahead prone inputs do."""
    out = df.withColumns({c: fill_forward(c, key, order) for c in columns})
    return out.withColumns({c: fill_backward(c, key, order) for c in columns}) if backfill else out


def lags(df: DataFrame, columns: list[str], ks: list[int], pattern: str, w: WindowSpec) -> DataFrame:
    """All lags in one projection over one window."""
    new = [F.lag(c, k).over(w).alias(pattern.format(c=c, k=k)) for k in ks for c in columns]
    return df.select("*", *new)


def normalised_lookback(df: DataFrame, n: int, w: WindowSpec, price: str = "close", volume: str = "volume") -> DataFrame:
    prices = [ratio(F.lag(price, k).over(w), price).alias(f"close_norm_lag{k}") for k in range(1, n + 1)]
    volumes = [ratio(F.lag(volume, k).over(w), F.col(volume) + 1).alias(f"volume_norm_lag{k}") for k in range(1, n + 1)]
    return df.select("*", *prices, *volumes)


def index_to_first(c: str, key: str | None = None, order: str = DATE) -> Column:
    """Value / first non-null value; 1.0 when there is none."""
    w = in_order(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(c, ignorenulls=True).over(w)
    return F.when(base.isNull(), F.lit(1.0)).otherwise(ratio(c, base))


def with_change_event(df: DataFrame, c: str, out: str, threshold: float = 0.001, key: str | None = None, order: str = DATE) -> DataFrame:
    """Percent change (0 when undefined) and a flag for |change| > threshold."""
    change = zero_if_null(pct_change(c, 1, in_order(key, order)))
    return df.withColumn(out, change).withColumn(f"{out}_flag", flag(F.abs(F.col(out)) > threshold))


def extreme_flag(r: str, w: WindowSpec, n: int = 20, min_periods: int = 10) -> Column:
    """|r| > 3 rolling sigma; undefined sigma gives 0."""
    return beyond_sigma(r, rolling(F.stddev_samp, r, n, min_periods, w))


def beyond_sigma(r: str, sigma: ColumnLike) -> Column:
    """|r| > 3 sigma; undefined sigma gives 0."""
    return flag(snap(F.abs(F.col(r)), 9) > snap(3 * col(sigma), 9))


def next_return(c: str, w: WindowSpec, k: int = 1) -> Column:
    return ratio(F.lead(c, k).over(w), c) - 1


def buffered_target(r: ColumnLike, buffer: float = 0.005) -> Column:
    """1 when r > buffer; anything else, null included, is 0."""
    return flag(snap(r, 9) > buffer)


def same_day_target(r: ColumnLike, buffer: float = 0.005) -> Column:
    s = snap(r, 9)
    return F.when(s > buffer, 1).when(s < -buffer, 0).cast("long")


def forward_mean(c: str, h: int, w: WindowSpec) -> Column:
    frame = w.rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(frame) == h, F.avg(c).over(frame))


def trend_ratio(c: str, past: int, h: int, w: WindowSpec) -> Column:
    return snap(ratio(forward_mean(c, h, w), rolling_mean(c, past, past, w)), 9)


def trend_target(r: ColumnLike, up: float = 1.001, down: float = 0.999) -> Column:
    return F.when(col(r) > up, 1).when(col(r) < down, 0).cast("long")


def date_gaps(df: DataFrame, key: str | None = KEY, order: str = DATE) -> DataFrame:
    gap = F.datediff(F.col(order), F.lag(order).over(in_order(key, order)))
    return df.withColumn("gap", gap.cast("long"))


def resample_weekly(bars: DataFrame, key: str = KEY, order: str = DATE) -> DataFrame:
    """Weeks ending Friday. Arg-min/arg-max aggregates combine map-side; empty weeks never appear."""
    week = F.next_day(F.date_sub(F.col(order), 1), "FRI").alias("week")
    return bars.groupBy(key, week).agg(
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.sum("volume").alias("volume"),
        F.min_by("sector", order).alias("sector"),
        F.min_by("isin", order).alias("isin"),
    )


def window_samples(
    bars: DataFrame,
    w: int = 5,
    step: int = 1,
    margin: float = 0.001,
    changes: tuple[str, ...] = (),
    levels: tuple[str, ...] = (),
    keep_neutral: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Three-week samples anchored on the last row of week 1.

    Week 0 and week 1 are trailing frames, week 2 a leading frame; rows without ten rows back
    and five forward have no sample. Columns named in `changes`, `levels` and `keep` must be on the bars.
    """
    order = by_key()
    w0, w1, w2 = order.rowsBetween(-(2 * w - 1), -w), order.rowsBetween(-(w - 1), 0), order.rowsBetween(1, w)
    past = order.rowsBetween(-(2 * w - 1), 0)
    staged = bars.withColumns(
        {"log_ret": log_return("close", order), "row_no": F.row_number().over(order).cast("long")}
    )
    cols = {
        "back_rows": F.count(F.lit(1)).over(past),
        "fwd_rows": F.count(F.lit(1)).over(w2),
        "p_past": F.avg("close").over(past),
        "p_future": F.avg("close").over(w2),
    }
    for d in range(w):
        cols[f"ret_w0_d{d}"] = F.lag("log_ret", 2 * w - 1 - d).over(order)
        cols[f"ret_w1_d{d}"] = F.lag("log_ret", w - 1 - d).over(order)
    for name, frame in (("w0", w0), ("w1", w1)):
        cols[f"ret_{name}_mean"] = F.avg("log_ret").over(frame)
        cols[f"ret_{name}_std"] = F.stddev_samp("log_ret").over(frame)
        cols[f"vol_{name}"] = F.avg("volume").over(frame)
    cols["cumret_w0"] = zero_if_null(ratio(F.lag("close", w).over(order), F.lag("close", 2 * w - 1).over(order)) - 1)
    cols["cumret_w1"] = zero_if_null(ratio("close", F.lag("close", w - 1).over(order)) - 1)
    for c in changes:
        cols[f"macro_{c}_change"] = zero_if_null(ratio(c, F.lag(c, w).over(order)) - 1)
    for c in levels:
        cols[f"macro_{c}_level"] = F.col(c)
    out = staged.withColumns(cols).filter(
        (F.col("back_rows") == 2 * w)
        & (F.col("fwd_rows") == w)
        & (F.col("p_past") > 0)
        & ((F.col("row_no") - 2 * w) % step == 0)
    )
    out = out.withColumn("ratio", snap(ratio("p_future", "p_past"), 9)).withColumn(
        "vol_change_w0w1", zero_if_null(ratio("vol_w1", "vol_w0") - 1)
    )
    if not keep_neutral:
        out = drop_neutral(out, "ratio", margin)
    out = out.withColumn("target", flag(F.col("ratio") > 1 + margin))
    features = [f"ret_{x}_d{d}" for x in ("w0", "w1") for d in range(w)]
    features += ["ret_w0_mean", "ret_w1_mean", "ret_w0_std", "ret_w1_std", "cumret_w0", "cumret_w1", "vol_change_w0w1"]
    features += [f"macro_{c}_change" for c in changes] + [f"macro_{c}_level" for c in levels]
    return out.select(KEY, DATE, "sector", "close", "ratio", "target", *features, *keep)


# ------------------------------------------------------------------ calendar, sets


def trading_calendar(start: ColumnLike, end: ColumnLike) -> Column:
    """Array of the days from start to end without Friday and Saturday."""
    days = F.sequence(col(start), col(end))
    return F.filter(days, lambda d: ~F.dayofweek(d).isin(6, 7))


def missing_trading_days(bars: DataFrame, window_days: int | None = 30, key: str = KEY, order: str = DATE) -> DataFrame:
    """Expected calendar days without a bar, per ticker, from its first bar to the newest date of the panel.

    The newest date is a scalar subquery; every ticker row expands its own calendar.
    """
    spans = bars.groupBy(key).agg(F.min(order).alias("first"))
    last = bars.agg(F.max(order).alias("last")).scalar()
    spans = spans.withColumn("last", last)
    start = F.greatest("first", F.date_sub("last", window_days)) if window_days else F.col("first")
    expected = spans.select(key, F.explode(trading_calendar(start, "last")).alias(order))
    return expected.join(bars.select(key, order), [key, order], "left_anti")


def split_leak_check(df: DataFrame, past: int = 10, future: int = 5) -> DataFrame:
    """Newest input date and oldest target date of every row."""
    w = by_key()
    return df.withColumn("last_input", F.max(DATE).over(w.rowsBetween(-(past - 1), 0))).withColumn(
        "first_target", F.min(DATE).over(w.rowsBetween(1, future))
    )
