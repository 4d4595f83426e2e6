"""Data audits: long result tables `check | value | status`, one aggregate pass per input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelmill.functions.columns import flag, snap
from panelmill.operators import features, panel, splits, stats
from panelmill.operators.panel import DATE, KEY, by_key


def _report(one: DataFrame, rows: list[tuple[str, Column, Column]]) -> DataFrame:
    """Unpivot a one-row frame into check | value | status."""
    entries = F.array(*[F.struct(F.lit(n).alias("check"), v.cast("double").alias("value"), s.alias("status")) for n, v, s in rows])
    return one.select(F.explode(entries).alias("_e")).select("_e.*")


def _status(ok: Column, bad: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise(bad)


# Limits of the audits.
LEAK, MIN_CLASS, MAX_CLASS, MIN_ROWS, RATIO_MIN, RATIO_MAX = 0.95, 0.10, 0.90, 1000, 0.01, 100.0
RATIO_COLUMNS = ("open_close_ratio", "high_low_ratio", "volume_relative_20")
REQUIRED_MACRO = ("usd_return_daily", "gold_return_daily", "gas_return", "gas_update_flag", "gdp_growth", "headline_inflation", "cbe_lending_rate")
RETURN_COLUMNS = ("usd_return_daily", "gold_return_daily", "gas_return", "price_roc_1")
ALLOWED_NEAR_ZERO, ZERO_SHARE, DUPLICATE_CORR, HIGH_CORR = 1e-4, 0.95, 0.999, 0.9


def quality_audit(df: DataFrame, feature_cols: list[str], target: str = "target_buffered", min_rows: int = MIN_ROWS) -> DataFrame:
    """GO when no feature predicts the target by itself and no raw column is left."""
    forbidden = [c for c in features.RAW_COLUMNS if c in df.columns]
    worst = F.greatest(*[F.coalesce(F.abs(F.corr(c, target)), F.lit(0.0)) for c in feature_cols], F.lit(0.0))
    outside = [F.when((F.min(c) < RATIO_MIN) | (F.max(c) > RATIO_MAX), 1).otherwise(0) for c in RATIO_COLUMNS if c in df.columns]
    unhealthy = stats.key_health(df, min_rows).agg(F.count_if(~F.col("healthy"))).scalar()
    one = df.agg(worst.alias("worst"), F.avg(target).alias("rate"), sum(outside[1:], outside[0]).alias("outside")).withColumn("unhealthy", unhealthy)
    leak_ok, raw_ok = F.col("worst") <= LEAK, F.lit(not forbidden)
    verdict = F.when(leak_ok & raw_ok, "GO").otherwise("NO-GO")
    return _report(
        one,
        [
            ("leakage", snap("worst", 6), _status(leak_ok, "FAIL")),
            ("class_balance", snap("rate", 6), _status(F.col("rate").between(MIN_CLASS, MAX_CLASS), "WARN")),
            ("key_health", F.col("unhealthy"), _status(F.col("unhealthy") == 0, "WARN")),
            ("ratio_ranges", F.col("outside"), _status(F.col("outside") == 0, "WARN")),
            ("forbidden_columns", F.lit(len(forbidden)), _status(raw_ok, "FAIL")),
            ("verdict", F.lit(None), verdict),
        ],
    )


def final_audit(df: DataFrame) -> DataFrame:
    """READY, REVIEW (warnings only) or NOT_READY."""
    missing = [c for c in REQUIRED_MACRO if c not in df.columns]
    forbidden = [c for c in features.RAW_COLUMNS if c in df.columns]
    near = F.abs("gas_return") < ALLOWED_NEAR_ZERO
    wild = [F.when((F.max(c) > 1) | (F.min(c) < -1), 1).otherwise(0) for c in RETURN_COLUMNS]
    one = df.agg(
        F.avg(F.when(near, 1.0).otherwise(0.0)).alias("zeros"),
        F.count_if(~near).alias("spikes"),
        F.corr("usd_return_daily", "gold_return_daily").alias("corr"),
        (F.when(F.max("gdp_growth") > 1, 1).otherwise(0) + F.when(F.max("cbe_lending_rate") > 100, 1).otherwise(0) + sum(wild[1:], wild[0])).alias("issues"),
    )
    gas_ok, split_ok, scale_ok = F.col("zeros") >= ZERO_SHARE, F.abs("corr") <= DUPLICATE_CORR, F.col("issues") == 0
    critical = F.lit(not missing and not forbidden)
    verdict = F.when(critical & gas_ok & split_ok & scale_ok, "READY").when(critical, "REVIEW").otherwise("NOT_READY")
    return _report(
        one,
        [
            ("required_columns", F.lit(len(missing)), _status(F.lit(not missing), "FAIL")),
            ("gas_zero_share", snap("zeros", 6), _status(gas_ok, "WARN")),
            ("gas_spikes", F.col("spikes"), F.lit("INFO")),
            ("fx_gold_corr", snap("corr", 6), F.when(~split_ok, "FAIL").when(F.abs("corr") > HIGH_CORR, "WARN").otherwise("PASS")),
            ("scale_issues", F.col("issues"), _status(scale_ok, "WARN")),
            ("forbidden_columns", F.lit(len(forbidden)), _status(F.lit(not forbidden), "FAIL")),
            ("verdict", F.lit(None), verdict),
        ],
    )


def integrity_audit(bars: DataFrame, macro: DataFrame, articles: DataFrame, stock_days: DataFrame) -> DataFrame:
    """Nulls, impossible prices, date gaps, article validity and all-zero sentiment columns."""
    nulls = lambda df: sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    ok = lambda c: _status(F.col(c) == 0, "WARN")
    value = lambda c: F.col(c)
    b = panel.date_gaps(bars)
    one_b = b.agg(
        sum((F.count_if(F.col(c).isNull()) for c in bars.columns[1:]), F.count_if(F.col(bars.columns[0]).isNull())).alias("nulls"),
        F.count_if((F.col("high") < F.col("low")) | (F.col("close") < 0)).alias("invalid"),
        F.count_if(F.col("gap") > 5).alias("gaps"),
        F.max("gap").alias("max_gap"),
    )
    m = panel.date_gaps(macro, key=None)
    one_m = m.agg(nulls(macro).alias("nulls"), F.count_if(F.col("gap") > 1).alias("gaps"), F.max("gap").alias("max_gap"))
    valid = F.col("title").isNotNull() & F.col("url").isNotNull() & F.col("dt").isNotNull()
    one_a = stats.duplicate_count(articles, "url", valid)
    sums = [F.when(F.sum(c) == 0, 1).otherwise(0) for c in ("direct_sentiment", "sector_sentiment")]
    one_s = stock_days.agg((sums[0] + sums[1]).alias("zero_columns"))
    info = lambda c: F.lit("INFO")
    parts = [
        _report(one_b, [("bars_nulls", value("nulls"), ok("nulls")), ("bars_invalid_prices", value("invalid"), _status(F.col("invalid") == 0, "FAIL")), ("bars_gaps", value("gaps"), ok("gaps")), ("bars_max_gap", value("max_gap"), info(""))]),
        _report(one_m, [("macro_nulls", value("nulls"), ok("nulls")), ("macro_gaps", value("gaps"), ok("gaps")), ("macro_max_gap", value("max_gap"), info(""))]),
        _report(one_a, [("articles_valid", value("n_valid"), info("")), ("articles_invalid", value("n_invalid"), ok("n_invalid")), ("articles_duplicate_urls", value("n_duplicate"), ok("n_duplicate"))]),
        _report(one_s, [("all_zero_sentiment", value("zero_columns"), ok("zero_columns"))]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gap_audit(bars: DataFrame, window_days: int = 30) -> DataFrame:
    """Per ticker: missing calendar days and bars of the recent window."""
    missing = panel.missing_trading_days(bars, window_days).groupBy(KEY).agg(F.count(F.lit(1)).alias("n_missing"))
    last = bars.agg(F.max(DATE)).scalar()
    recent = bars.groupBy(KEY).agg(F.max(DATE).alias("last"), F.count_if(F.col(DATE) >= F.date_sub(last, window_days)).alias("n_recent"))
    out = recent.join(missing, KEY, "left").withColumn("n_missing", F.coalesce("n_missing", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("n_missing") == 0, "COMPLETE").when(F.col("n_recent") > 0, "GAPS").otherwise("SILENT"))


def leak_audit(samples: DataFrame, bars: DataFrame, feature: str) -> DataFrame:
    """Input before target on every row, splits in date order, standardisation from training rows only."""
    frames = panel.split_leak_check(bars.select(KEY, DATE)).agg(F.count_if(F.col("first_target") <= F.col("last_input")).alias("n"))
    labelled = splits.purged_split(samples.select(KEY, DATE, feature))
    edge = lambda agg, s: agg(F.when(F.col("split") == s, F.col(DATE)))
    order = labelled.groupBy(KEY).agg(
        edge(F.max, "train").alias("a"), edge(F.min, "val").alias("b"), edge(F.max, "val").alias("c"), edge(F.min, "test").alias("d")
    )
    order = order.agg(F.count_if((F.col("a") >= F.col("b")) | (F.col("c") >= F.col("d")) | (F.col("a") >= F.col("d"))).alias("n"))
    z = splits.standardise(labelled, [feature], F.col("split") == "train").filter("split = 'train'")
    centred = z.groupBy(KEY).agg(F.avg(feature).alias("m"), F.stddev_samp(feature).alias("s"))
    centred = centred.agg(F.count_if((F.abs("m") > 1e-6) | (F.abs(F.col("s") - 1) > 1e-6)).alias("n"))
    ok = _status(F.col("n") == 0, "FAIL")
    out = _report(frames, [("input_before_target", F.col("n"), ok)])
    return out.unionByName(_report(order, [("splits_in_order", F.col("n"), ok)])).unionByName(_report(centred, [("train_only_statistics", F.col("n"), ok)]))


def data_health(bars: DataFrame, macro: DataFrame, k: int = 3) -> DataFrame:
    """kind | ticker | dt | value: price anomalies, largest moves, macro series with values."""
    moves = bars.select(KEY, DATE, snap(panel.pct_change("close", 1, by_key()), 9).alias("value")).filter("value IS NOT NULL")
    top = lambda order, kind: moves.orderBy(order, KEY, DATE).limit(k).select(F.lit(kind).alias("kind"), KEY, DATE, snap("value").alias("value"))
    none = lambda t: F.lit(None).cast(t)
    single = lambda df, kind, v: df.agg(v.cast("double").alias("value")).select(F.lit(kind).alias("kind"), none("string").alias(KEY), none("date").alias(DATE), "value")
    out = top(F.asc("value"), "drop").unionByName(top(F.desc("value"), "gain"))
    out = out.unionByName(single(bars, "close_below_0.01", F.count_if(F.col("close") < 0.01)))
    out = out.unionByName(single(bars, "close_null", F.count_if(F.col("close").isNull())))
    for c in ("usd_sell_rate", "gold_24k", "gasoline_92"):
        out = out.unionByName(single(macro, f"has_{c}", flag(F.count(c) > 0)))
    return out
