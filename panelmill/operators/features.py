"""Feature tables: compositions of the panel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelmill.functions.columns import flag, has_news, ratio, snap, zero_if_null
from panelmill.operators import panel
from panelmill.operators.panel import by_date, by_key, pct_change

# Output columns and forbidden raw columns of the prepared tables.
TRAINING_COLUMNS = [
    "dt", "ticker", "sector", "target_buffered", "open_close_ratio", "high_low_ratio", "volume_relative_20",
    "price_roc_1", "usd_return_daily", "gold_return_daily", "gas_return", "gas_update_flag", "gdp_growth",
    "headline_inflation", "cbe_lending_rate", "close",
]
RAW_COLUMNS = ["open", "high", "low", "volume", "usd_sell_rate", "gold_24k", "gasoline_92", "gdp_usd_billion"]
TRAINING_FEATURES = TRAINING_COLUMNS[4:-1]


def macro_features(macro: DataFrame) -> DataFrame:
    """Daily returns of the step and price series; levels as they are."""
    w = by_date()
    gas = zero_if_null(pct_change("gasoline_92", 1, w))
    return macro.select(
        "dt",
        zero_if_null(pct_change("usd_sell_rate", 1, w)).alias("usd_return_daily"),
        zero_if_null(pct_change("gold_24k", 1, w)).alias("gold_return_daily"),
        gas.alias("gas_return"),
        flag(F.abs(gas) > 0.001).alias("gas_update_flag"),
        zero_if_null(pct_change("gdp_usd_billion", 1, w)).alias("gdp_growth"),
        "headline_inflation",
        "cbe_lending_rate",
    )


def fill_median(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Nulls take the column's median; all medians come from one scalar subquery.

    The exact form counts distinct values, which macro levels bound by the calendar; a free-valued
    column of a large panel should ask for the approximate one.
    """
    median = (lambda c: F.percentile_approx(c, 0.5)) if approximate else F.median
    medians = df.agg(F.struct(*[median(c).alias(c) for c in columns])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), medians[c]) for c in columns})


def join_macro_features(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Returns and flags filled with 0, levels filled forward within the ticker."""
    joined = panel.join_macro(bars, macro_features(macro))
    zeros = ["usd_return_daily", "gold_return_daily", "gas_return", "gas_update_flag", "gdp_growth"]
    return panel.fill_columns(joined.fillna(0, subset=zeros), ["headline_inflation", "cbe_lending_rate"])


def price_features(bars: DataFrame) -> DataFrame:
    w = by_key()
    return bars.withColumns(
        {
            "open_close_ratio": ratio("open", "close"),
            "high_low_ratio": ratio("high", "low"),
            "volume_relative_20": panel.volume_ratio("volume", 20, 1, w),
            "price_roc_1": pct_change("close", 1, w),
            "next_ret": panel.next_return("close", w),
        }
    )


def prepare_training(bars: DataFrame, macro: DataFrame) -> DataFrame:
    """Suspended days out, ratios, macro returns, buffered next-day target, last row per ticker out, nulls out."""
    priced = price_features(panel.drop_suspended(bars))
    joined = fill_median(join_macro_features(priced, macro), ["headline_inflation", "cbe_lending_rate"])
    out = joined.withColumn("target_buffered", panel.buffered_target("next_ret")).filter("next_ret IS NOT NULL")
    out = panel.assert_no_forbidden(panel.select_available(out, TRAINING_COLUMNS), RAW_COLUMNS)
    return out.dropna()


# Features of the lagged table.
LAGGED_BASE = ["return_t", "vol_ratio", "high_low_ratio", "usd_return", "gold_return", "gas_index", "headline_inflation", "cbe_lending_rate"]
LAGGED_MEMORY = ["return_t", "vol_ratio", "gold_return"]


def lagged_features(bars: DataFrame, macro: DataFrame, clip: float = 0.5) -> DataFrame:
    """Core and macro features with two rows of memory, next-day target, outliers and incomplete rows out."""
    w, d = by_key(), by_date()
    m = macro.select(
        "dt",
        pct_change("usd_sell_rate", 1, d).alias("usd_return"),
        pct_change("gold_24k", 1, d).alias("gold_return"),
        panel.index_to_first("gasoline_92").alias("gas_index"),
        "headline_inflation",
        "cbe_lending_rate",
    )
    core = panel.drop_suspended(bars).withColumns(
        {
            "return_t": pct_change("close", 1, w),
            "vol_ratio": panel.volume_ratio("volume", 20, 1, w),
            "high_low_ratio": ratio("high", "low"),
            "next_ret": panel.next_return("close", w),
        }
    )
    macro_cols = ["usd_return", "gold_return", "gas_index", "headline_inflation", "cbe_lending_rate"]
    joined = panel.fill_columns(panel.join_macro(core, m), macro_cols).fillna(0, subset=macro_cols)
    remembered = panel.lags(joined, LAGGED_MEMORY, [1, 2], "{c}_lag{k}", w)
    out = remembered.withColumn("target", panel.buffered_target("next_ret")).withColumn("return_t", snap("return_t", 9))
    out = panel.clip_filter(out, "return_t", -clip, clip).filter("next_ret IS NOT NULL")
    lag_cols = [f"{c}_lag{k}" for k in (1, 2) for c in LAGGED_MEMORY]
    return out.select("dt", "ticker", "sector", "target", "close", *LAGGED_BASE, *lag_cols).dropna()


def prepare_clean(bars: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """Same-day target (null in the neutral zone), ratios and a news flag; sentiment joined when given."""
    w = by_key()
    df = bars
    extra = []
    if sentiment is not None:
        extra = ["direct_sentiment", "sector_sentiment", "direct_count", "sector_count"]
        df = df.join(sentiment.select("dt", "ticker", *extra), ["dt", "ticker"], "left")
    r = pct_change("close", 1, w)
    news_flag = has_news("direct_count") if extra else F.lit(0).cast("long")
    return df.select(
        "dt", "ticker", "sector",
        r.alias("ret"),
        panel.same_day_target(r).alias("target_buffered"),
        ratio("open", "close").alias("open_close_ratio"),
        ratio("high", "low").alias("high_low_ratio"),
        panel.volume_ratio("volume", 20, 1, w).alias("vol_ma_ratio"),
        news_flag.alias("has_news"),
        "close", "volume", *extra,
    )


def daily_features_v1(bars: DataFrame, lookback: int = 10) -> DataFrame:
    """Returns, volatilities, ranges, volume ratios, RSI, extreme flag and normalised look-back.

    Two passes over a ticker's rows: lags first, then the frames over them, each frame's deviation once.
    """
    w = by_key()
    gain, loss = panel.gain_and_loss("close", w)
    df = panel.normalised_lookback(bars, lookback, w)
    lookbacks = df.columns[len(bars.columns) :]
    df = df.withColumns({**{f"return_{k}d": pct_change("close", k, w) for k in (1, 5, 10)}, "_gain": gain, "_loss": loss})
    df = df.withColumns(
        {
            **{f"volatility_{n}d": panel.volatility("return_1d", n, w) for n in (5, 10, 20)},
            "high_low_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
            "close_open_ratio": ratio("close", "open"),
            **{f"volume_ma_ratio_{n}": panel.volume_ratio("volume", n, 2, w) for n in (5, 10)},
            **panel.rsi_means("_gain", "_loss", 14, w),
        }
    )
    df = df.withColumns({"is_extreme_volatility": panel.beyond_sigma("return_1d", "volatility_20d"), "rsi_14": panel.rsi(14)})
    df = df.drop("_gain", "_loss", "_up", "_down", "_seen")
    df = df.select(*[c for c in df.columns if c not in lookbacks], *lookbacks)
    if "rate_spread" in df.columns:
        df = df.withColumn("rate_spread_lag1", F.lag("rate_spread").over(w))
    return df


def weekly_features_v2(weekly: DataFrame) -> DataFrame:
    """Features of weekly bars that already carry the filled macro columns."""
    w = by_key(order="week")
    df = weekly.withColumns({f"ret_{k}w": pct_change("close", k, w) for k in (1, 2, 4, 8, 12)})
    cols = {
        **{f"vol_{n}w": panel.volatility("ret_1w", n, w, 2) for n in (4, 8)},
        "weekly_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
        "volume_ratio_4w": panel.volume_ratio("volume", 4, 2, w),
        **{f"price_vs_ma{n}": panel.price_vs_ma("close", n, 2, w) for n in (4, 8)},
        "target": flag(F.lead("close").over(w) > F.col("close")),
    }
    for c in ("sp500", "oil", "gold_intl"):
        for k in (1, 4):
            cols[f"{c}_ret_{k}w"] = pct_change(c, k, w)
    for c in ("usd_sell_rate", "gold_24k"):
        for k in (1, 4):
            cols[f"{c}_change_{k}w"] = pct_change(c, k, w)
    cols["vix_change_1w"] = pct_change("vix", 1, w)
    cols["vix_ma_ratio"] = ratio("vix", panel.rolling_mean("vix", 4, 2, w))
    cols["oil_gold_ratio"] = ratio("oil", "gold_intl")
    cols["real_rate"] = F.col("cbe_lending_rate") - F.col("headline_inflation")
    return panel.with_rsi(df.withColumns(cols), "close", 4, "rsi_4w", order="week")
