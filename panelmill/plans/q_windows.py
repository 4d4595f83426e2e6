"""Window functions and time-series features (E)."""

from pyspark.sql import functions as F

from panelmill.functions.columns import flag, ratio, snap
from panelmill.operators import features, learners, panel, splits
from panelmill.operators.panel import by_key, pct_change
from panelmill.plans.registry import query

W = "WINDOW w AS (PARTITION BY ticker ORDER BY dt)"
ID = ("ticker", "dt")


def s6(*names):
    return [snap(n).alias(n) for n in names]


def frame(n, name="f"):
    return f"{name} AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def last_known(c, over="u"):
    return f"last_value({c} IGNORE NULLS) OVER {over}"


UPTO = "u AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
UPTO_D = "u AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
KS = (1, 2, 4, 5, 8, 10, 12)


@query("e01_returns", "SELECT ticker, dt, " + ", ".join(f"SNAP6(close / lag(close, {k}) OVER w - 1) AS ret_{k}" for k in KS) + f" FROM bars_v {W}")
def returns(t):
    return t.bars.select(*ID, *[snap(pct_change("close", k, by_key())).alias(f"ret_{k}") for k in KS])


@query("e02_log_return", f"SELECT ticker, dt, SNAP6(coalesce(ln(close / lag(close) OVER w), 0)) AS log_ret FROM bars_v {W}")
def log_return(t):
    return t.bars.select(*ID, snap(panel.log_return("close", by_key())).alias("log_ret"))


@query(
    "e03_lags",
    "SELECT ticker, dt, " + ", ".join(f"SNAP6(lag({c}, {k}) OVER w) AS {c}_lag{k}" for k in (1, 2) for c in ("close", "volume")) + f" FROM traded_v {W}",
)
def lags(t):
    out = panel.lags(t.traded, ["close", "volume"], [1, 2], "{c}_lag{k}", by_key())
    return out.select(*ID, *s6(*[f"{c}_lag{k}" for k in (1, 2) for c in ("close", "volume")]))


BASE = ["return_t", "vol_ratio", "usd_return", "gold_return", "gas_index"]


@query(
    "e04_lookback_matrix",
    "SELECT ticker, dt, " + ", ".join(f"SNAP6(lag({c}, {k}) OVER w) AS {c}_l{k}" for k in range(10) for c in BASE) + f" FROM lagged_v {W}",
)
def lookback_matrix(t):
    out = panel.lags(t.lagged, BASE, list(range(10)), "{c}_l{k}", by_key())
    return out.select(*ID, *s6(*[f"{c}_l{k}" for k in range(10) for c in BASE]))


@query(
    "e05_rolling_mean",
    f"""SELECT ticker, dt, SNAP6(avg(volume) OVER f) AS vol_ma_20, SNAP6(CASE WHEN count(close) OVER g >= 10 THEN avg(close) OVER g END) AS close_ma_10
    FROM bars_v WINDOW {frame(20)}, {frame(10, 'g')}""",
)
def rolling_mean(t):
    w = by_key()
    return t.bars.select(
        *ID, snap(panel.rolling_mean("volume", 20, 1, w)).alias("vol_ma_20"), snap(panel.rolling_mean("close", 10, 10, w)).alias("close_ma_10")
    )


@query(
    "e06_volatility",
    f"""WITH r AS (SELECT ticker, dt, close / lag(close) OVER w - 1 AS r FROM bars_v {W})
    SELECT ticker, dt, """
    + ", ".join(f"SNAP6(CASE WHEN count(r) OVER f{n} >= {max(3, n // 2)} THEN stddev_samp(r) OVER f{n} END) AS volatility_{n}" for n in (5, 10, 20))
    + ", SNAP6(CASE WHEN count(r) OVER f4 >= 2 THEN stddev_samp(r) OVER f4 END) AS weekly_vol_4 FROM r WINDOW "
    + ", ".join(frame(n, f"f{n}") for n in (4, 5, 10, 20)),
)
def volatility(t):
    w = by_key()
    r = t.bars.select(*ID, pct_change("close", 1, w).alias("r"))
    cols = [snap(panel.volatility("r", n, w)).alias(f"volatility_{n}") for n in (5, 10, 20)]
    return r.select(*ID, *cols, snap(panel.volatility("r", 4, w, 2)).alias("weekly_vol_4"))


@query(
    "e07_volume_ratio",
    f"""SELECT ticker, dt, SNAP6(volume / nullif(avg(volume) OVER f, 0)) AS volume_relative_20,
    SNAP6(CASE WHEN count(volume) OVER g >= 2 THEN volume / nullif(avg(volume) OVER g, 0) END) AS volume_ma_ratio_5
    FROM bars_v WINDOW {frame(20)}, {frame(5, 'g')}""",
)
def volume_ratio(t):
    w = by_key()
    return t.bars.select(
        *ID, snap(panel.volume_ratio("volume", 20, 1, w)).alias("volume_relative_20"), snap(panel.volume_ratio("volume", 5, 2, w)).alias("volume_ma_ratio_5")
    )


LOOK = [f"close_norm_lag{k}" for k in range(1, 11)] + [f"volume_norm_lag{k}" for k in range(1, 11)]


@query(
    "e08_normalised_lookback",
    "SELECT ticker, dt, "
    + ", ".join(f"SNAP6(lag(close, {k}) OVER w / close) AS close_norm_lag{k}, SNAP6(lag(volume, {k}) OVER w / (volume + 1)) AS volume_norm_lag{k}" for k in range(1, 11))
    + f" FROM bars_v {W}",
)
def normalised_lookback(t):
    return panel.normalised_lookback(t.bars, 10, by_key()).select(*ID, *s6(*LOOK))


def rsi_sql(n, source="bars_v", order="dt"):
    return f"""WITH d AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY ticker ORDER BY {order}), 0) AS delta FROM {source}),
    m AS (SELECT *, SNAP9(avg(greatest(delta, 0)) OVER f) AS g, SNAP9(avg(greatest(-delta, 0)) OVER f) AS l, count(*) OVER f AS c
          FROM d WINDOW f AS (PARTITION BY ticker ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW))
    SELECT ticker, {order}, SNAP6(CASE WHEN c >= {n} THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END END) AS rsi FROM m"""


@query("e09_rsi", rsi_sql(14))
def rsi(t):
    return panel.with_rsi(t.bars, "close", 14, "rsi").select(*ID, *s6("rsi"))


@query(
    "e10_extreme_flag",
    f"""WITH r AS (SELECT ticker, dt, close / lag(close) OVER w - 1 AS r FROM bars_v {W})
    SELECT ticker, dt, CAST(CASE WHEN count(r) OVER f >= 10 AND SNAP9(abs(r)) > SNAP9(3 * stddev_samp(r) OVER f) THEN 1 ELSE 0 END AS BIGINT) AS is_extreme
    FROM r WINDOW {frame(20)}""",
)
def extreme_flag(t):
    w = by_key()
    r = t.bars.select(*ID, pct_change("close", 1, w).alias("r"))
    return r.select(*ID, panel.extreme_flag("r", w).alias("is_extreme"))


@query(
    "e11_price_vs_ma",
    f"""SELECT ticker, dt, """
    + ", ".join(f"SNAP6(CASE WHEN count(close) OVER f{n} >= 2 THEN close / avg(close) OVER f{n} - 1 END) AS price_vs_ma{n}" for n in (4, 8))
    + " FROM bars_v WINDOW " + ", ".join(frame(n, f"f{n}") for n in (4, 8)),
)
def price_vs_ma(t):
    w = by_key()
    return t.bars.select(*ID, *[snap(panel.price_vs_ma("close", n, 2, w)).alias(f"price_vs_ma{n}") for n in (4, 8)])


@query(
    "e12_intraday_ratios",
    """SELECT ticker, dt, SNAP6(open / close) AS open_close_ratio, SNAP6(high / low) AS high_low_ratio,
    SNAP6((high - low) / close) AS high_low_range, SNAP6(close / open) AS close_open_ratio FROM bars_v""",
)
def intraday_ratios(t):
    return t.bars.select(
        *ID,
        snap(ratio("open", "close")).alias("open_close_ratio"),
        snap(ratio("high", "low")).alias("high_low_ratio"),
        snap(F.try_divide(F.col("high") - F.col("low"), "close")).alias("high_low_range"),
        snap(ratio("close", "open")).alias("close_open_ratio"),
    )


@query(
    "e13_fill_forward",
    f"""SELECT ticker, b.dt, {last_known('cbe_lending_rate')} AS rate_ffill,
    coalesce({last_known('cbe_lending_rate')}, first_value(cbe_lending_rate IGNORE NULLS) OVER d) AS rate_both
    FROM bars_v b LEFT JOIN macro_v m ON b.dt = m.dt
    WINDOW u AS (PARTITION BY ticker ORDER BY b.dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           d AS (PARTITION BY ticker ORDER BY b.dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def fill_forward(t):
    df = panel.join_macro(t.bars, t.macro.select("dt", "cbe_lending_rate"))
    df = df.withColumns({"rate_ffill": F.col("cbe_lending_rate"), "rate_both": F.col("cbe_lending_rate")})
    df = panel.fill_columns(df, ["rate_ffill"])
    return panel.fill_columns(df, ["rate_both"], backfill=True).select(*ID, "rate_ffill", "rate_both")


@query(
    "e14_index_to_first",
    """SELECT dt, SNAP6(gasoline_92 / first_value(gasoline_92) OVER (ORDER BY dt)) AS gas_index,
    SNAP6(cbe_lending_rate / (SELECT arg_min(cbe_lending_rate, dt) FROM macro_v WHERE cbe_lending_rate IS NOT NULL)) AS rate_index FROM macro_v""",
)
def index_to_first(t):
    return t.macro.select(
        "dt", snap(panel.index_to_first("gasoline_92")).alias("gas_index"), snap(panel.index_to_first("cbe_lending_rate")).alias("rate_index")
    )


@query(
    "e15_date_gaps",
    f"""WITH g AS (SELECT ticker, date_diff('day', lag(dt) OVER w, dt) AS gap FROM bars_v {W})
    SELECT ticker, count(*) AS n_rows, count(*) FILTER (WHERE gap > 5) AS n_gaps, max(gap) AS max_gap FROM g GROUP BY ticker""",
)
def date_gaps(t):
    return panel.date_gaps(t.bars.select(*ID)).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("gap") > 5).alias("n_gaps"), F.max("gap").alias("max_gap")
    )


@query(
    "e16_next_return",
    f"""SELECT ticker, dt, SNAP6(lead(close) OVER w / close - 1) AS next_ret,
    CAST(CASE WHEN SNAP9(lead(close) OVER w / close - 1) > 0.005 THEN 1 ELSE 0 END AS BIGINT) AS target_buffered FROM bars_v {W}""",
)
def next_return(t):
    r = panel.next_return("close", by_key())
    return t.bars.select(*ID, snap(r).alias("next_ret"), panel.buffered_target(r).alias("target_buffered"))


WEEKLY = """SELECT ticker, CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INT) AS DATE) AS week, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, dt) AS close, CAST(sum(volume) AS BIGINT) AS volume, arg_min(sector, dt) AS sector, arg_min(isin, dt) AS isin FROM bars_v GROUP BY 1, 2"""


@query(
    "e17_weekly_target",
    f"""WITH k AS ({WEEKLY}) SELECT ticker, week, SNAP6(close) AS close,
    CAST(CASE WHEN lead(close) OVER (PARTITION BY ticker ORDER BY week) > close THEN 1 ELSE 0 END AS BIGINT) AS target FROM k""",
)
def weekly_target(t):
    w = by_key(order="week")
    k = panel.resample_weekly(t.bars)
    return k.select("ticker", "week", snap("close").alias("close"), flag(F.lead("close").over(w) > F.col("close")).alias("target"))


@query(
    "e18_forward_mean",
    """SELECT ticker, dt, SNAP6(CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f END) AS forward_mean_5 FROM bars_v
    WINDOW f AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)""",
)
def forward_mean(t):
    return t.bars.select(*ID, snap(panel.forward_mean("close", 5, by_key())).alias("forward_mean_5"))


@query("e19_forward_return", f"SELECT ticker, dt, SNAP6(lead(close, 5) OVER w / close - 1) AS forward_return_5 FROM bars_v {W}")
def forward_return(t):
    return t.bars.select(*ID, snap(panel.next_return("close", by_key(), 5)).alias("forward_return_5"))


@query(
    "e20_trend_target",
    f"""WITH m AS (SELECT ticker, dt, SNAP9(CASE WHEN count(*) OVER f = 5 AND count(*) OVER p = 10 THEN avg(close) OVER f / avg(close) OVER p END) AS trend_ratio
    FROM bars_v WINDOW f AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), {frame(10, 'p')})
    SELECT ticker, dt, SNAP6(trend_ratio) AS trend_ratio, CAST(CASE WHEN trend_ratio > 1.001 THEN 1 WHEN trend_ratio < 0.999 THEN 0 END AS BIGINT) AS target_t5 FROM m""",
)
def trend_target(t):
    df = t.bars.select(*ID, panel.trend_ratio("close", 10, 5, by_key()).alias("r"))
    return df.select(*ID, snap("r").alias("trend_ratio"), panel.trend_target("r").alias("target_t5"))


@query(
    "e21_same_day_target",
    f"""WITH r AS (SELECT ticker, dt, SNAP9(close / lag(close) OVER w - 1) AS r FROM bars_v {W})
    SELECT ticker, dt, CAST(CASE WHEN r > 0.005 THEN 1 WHEN r < -0.005 THEN 0 END AS BIGINT) AS target FROM r""",
)
def same_day_target(t):
    return t.bars.select(*ID, panel.same_day_target(pct_change("close", 1, by_key())).alias("target"))


SAMPLE = (
    [f"ret_{x}_d{d}" for x in ("w0", "w1") for d in range(5)]
    + ["ret_w0_mean", "ret_w1_mean", "ret_w0_std", "ret_w1_std", "cumret_w0", "cumret_w1", "vol_change_w0w1", "macro_usd_egp_change", "macro_cbe_lending_rate_level"]
)


@query("e22_three_week_samples", "SELECT ticker, dt, target, SNAP6(ratio) AS ratio, " + ", ".join(f"SNAP6({c}) AS {c}" for c in SAMPLE) + " FROM samples_v")
def three_week_samples(t):
    return t.samples.select(*ID, "target", *s6("ratio", *SAMPLE))


@query("e23_drop_last_per_key", f"SELECT ticker, dt, close FROM (SELECT *, lead(dt) OVER w AS nx FROM bars_v {W}) WHERE nx IS NOT NULL")
def drop_last(t):
    return panel.drop_last_per_key(t.bars).select(*ID, "close")


@query(
    "e24_dedupe_keep_last",
    """SELECT ticker, last_day, dt, close FROM (SELECT ticker, date_trunc('month', dt)::DATE AS last_day, dt, close,
       row_number() OVER (PARTITION BY ticker, date_trunc('month', dt) ORDER BY dt DESC) AS rn FROM bars_v) WHERE rn = 1""",
)
def dedupe_keep_last(t):
    df = t.bars.select("ticker", F.trunc("dt", "month").alias("last_day"), "dt", "close")
    return panel.dedupe_keep_last(df, ["ticker", "last_day"], "dt")


@query(
    "e25_time_split",
    """SELECT ticker, dt, row_no, n_rows, CASE WHEN row_no <= floor(CAST(n_rows AS DOUBLE) * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM
    (SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS row_no, count(*) OVER (PARTITION BY ticker) AS n_rows FROM training_v)""",
)
def time_split(t):
    return splits.time_split(t.training.select(*ID))


@query(
    "e26_embargo_split",
    """WITH p AS (SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS row_no, count(*) OVER (PARTITION BY ticker) AS n_rows FROM training_v),
    q AS (SELECT *, floor(CAST(n_rows AS DOUBLE) * CAST(0.7 AS DOUBLE)) AS a, floor(CAST(n_rows AS DOUBLE) * CAST(0.1 AS DOUBLE)) AS v FROM p)
    SELECT ticker, dt, row_no, n_rows, CASE WHEN row_no <= a THEN 'train' WHEN row_no <= a + 5 THEN NULL WHEN row_no <= a + 5 + v THEN 'val'
      WHEN row_no <= a + 5 + v + 5 THEN NULL ELSE 'test' END AS split FROM q""",
)
def embargo_split(t):
    return splits.embargo_split(t.training.select(*ID))


@query("e27_purged_split", "SELECT ticker, dt, row_no, n_rows, split FROM split_v")
def purged_split(t):
    return splits.purged_split(t.samples.select(*ID))


FOLDS = """WITH p AS (SELECT ticker, dt, row_number() OVER (PARTITION BY ticker ORDER BY dt) AS row_no, count(*) OVER (PARTITION BY ticker) AS n FROM bars_v),
    k AS (SELECT ticker, n, unnest(generate_series(0, CAST(n AS BIGINT))) AS fold FROM (SELECT DISTINCT ticker, n FROM p)),
    f AS (SELECT ticker, fold, {win} + 4 + fold * 63 AS test_start FROM k WHERE {win} + 4 + fold * 63 + 63 <= n)
    SELECT p.ticker, dt, row_no, fold, CASE WHEN row_no - 1 >= test_start THEN 'test' ELSE 'train' END AS role FROM p JOIN f ON p.ticker = f.ticker
      AND ((row_no - 1 >= test_start AND row_no - 1 < test_start + 63) OR (row_no - 1 >= test_start - 4 - {win} AND row_no - 1 < test_start - 4))"""


@query("e28_walk_forward_folds", " UNION ALL ".join(f"SELECT '{name}' AS \"window\", * FROM ({FOLDS.replace('{win}', str(size))})" for name, size in learners.WINDOWS.items()))
def walk_forward_folds(t):
    return splits.walk_forward_folds(t.bars.select(*ID), learners.WINDOWS)


@query(
    "e29_change_event",
    """SELECT dt, SNAP6(gas_return) AS gas_return, gas_update_flag AS gas_return_flag FROM macro_feat_v""",
)
def change_event(t):
    return panel.with_change_event(t.macro, "gasoline_92", "gas_return").select("dt", snap("gas_return").alias("gas_return"), "gas_return_flag")


@query(
    "e30_series_momentum",
    "SELECT ticker, dt, " + ", ".join(f"SNAP6({c} / nullif(lag({c}, {k}) OVER w, 0) - 1) AS {c}_ret_{k}" for c in ("sp500", "oil", "usd_sell_rate") for k in (1, 4)) + f" FROM market_v {W}",
)
def series_momentum(t):
    w = by_key()
    return t.market.select(*ID, *[snap(pct_change(c, k, w)).alias(f"{c}_ret_{k}") for c in ("sp500", "oil", "usd_sell_rate") for k in (1, 4)])


@query(
    "e31_level_vs_ma",
    f"""SELECT ticker, dt, SNAP6(vix) AS vix_level, SNAP6(vix / nullif(lag(vix) OVER w, 0) - 1) AS vix_change_1w,
    SNAP6(CASE WHEN count(vix) OVER f >= 2 THEN vix / avg(vix) OVER f END) AS vix_ma_ratio FROM market_v {W}, {frame(4)}""",
)
def level_vs_ma(t):
    w = by_key()
    return t.market.select(
        *ID, snap("vix").alias("vix_level"), snap(pct_change("vix", 1, w)).alias("vix_change_1w"),
        snap(ratio("vix", panel.rolling_mean("vix", 4, 2, w))).alias("vix_ma_ratio"),
    )


@query(
    "e32_cross_asset",
    f"""SELECT ticker, dt, SNAP6((oil / nullif(lag(oil) OVER w, 0) - 1) - (sp500 / nullif(lag(sp500) OVER w, 0) - 1)) AS oil_vs_sp500,
    SNAP6(oil / nullif(gold_intl, 0)) AS oil_gold_ratio, SNAP6(gold_24k / nullif(gold_intl * usd_sell_rate, 0) - 1) AS gold_premium,
    SNAP6(cbe_lending_rate - headline_inflation) AS real_rate FROM market_v {W}""",
)
def cross_asset(t):
    w = by_key()
    return t.market.select(
        *ID,
        snap(pct_change("oil", 1, w) - pct_change("sp500", 1, w)).alias("oil_vs_sp500"),
        snap(ratio("oil", "gold_intl")).alias("oil_gold_ratio"),
        snap(ratio("gold_24k", F.col("gold_intl") * F.col("usd_sell_rate")) - 1).alias("gold_premium"),
        snap(F.col("cbe_lending_rate") - F.col("headline_inflation")).alias("real_rate"),
    )


@query(
    "e33_difference",
    """SELECT sector, dt, SNAP6(close - lag(close) OVER w) AS d1, SNAP6((close - lag(close) OVER w) - (lag(close) OVER w - lag(close, 2) OVER w)) AS d2
    FROM sector_day_v WINDOW w AS (PARTITION BY sector ORDER BY dt)""",
)
def difference(t):
    w = by_key("sector")
    d1 = t.sector_days.withColumn("d1", F.col("close") - F.lag("close").over(w))
    return d1.select("sector", "dt", snap("d1").alias("d1"), snap(F.col("d1") - F.lag("d1").over(w)).alias("d2"))


@query(
    "e34_last_vs_previous",
    """SELECT ticker, dt, SNAP6(close) AS last_close, SNAP6(close - prev) AS change, SNAP6((close - prev) / nullif(prev, 0) * 100) AS change_pct FROM
    (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY dt) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY dt DESC) AS rn FROM bars_v) WHERE rn = 1""",
)
def last_vs_previous(t):
    prev = F.lag("close").over(by_key())
    df = t.bars.select(*ID, "close", prev.alias("prev"))
    last = panel.dedupe_keep_last(df.select("ticker", "dt", "close", "prev"), ["ticker"], "dt")
    return last.select(
        *ID, snap("close").alias("last_close"), snap(F.col("close") - F.col("prev")).alias("change"),
        snap(ratio(F.col("close") - F.col("prev"), "prev") * 100).alias("change_pct"),
    )


@query(
    "e35_lag_spread",
    f"""WITH j AS (SELECT ticker, dt, cbe_lending_rate - headline_inflation AS rate_spread FROM market_v)
    SELECT ticker, dt, SNAP6(rate_spread) AS rate_spread, SNAP6(lag(rate_spread) OVER w) AS rate_spread_lag1 FROM j {W}""",
)
def lag_spread(t):
    df = t.market.select(*ID, (F.col("cbe_lending_rate") - F.col("headline_inflation")).alias("rate_spread"))
    return df.select(*ID, snap("rate_spread").alias("rate_spread"), snap(F.lag("rate_spread").over(by_key())).alias("rate_spread_lag1"))


@query(
    "e36_holiday_gap",
    f"""SELECT ticker, dt, date_diff('day', lag(dt) OVER w, dt) - 1 AS holiday_gap,
    CAST(CASE WHEN date_diff('day', lag(dt) OVER w, dt) - 1 > 2 THEN 1 ELSE 0 END AS BIGINT) AS is_post_holiday FROM bars_v {W}""",
)
def holiday_gap(t):
    g = panel.date_gaps(t.bars.select(*ID))
    return g.select(*ID, (F.col("gap") - 1).alias("holiday_gap"), flag(F.col("gap") - 1 > 2).alias("is_post_holiday"))


MACRO_OUT = ["usd_return_daily", "gold_return_daily", "gas_return", "gdp_growth", "headline_inflation", "cbe_lending_rate"]


@query("e37_macro_features", "SELECT ticker, dt, gas_update_flag, " + ", ".join(f"SNAP6({c}) AS {c}" for c in MACRO_OUT) + " FROM training_v")
def macro_features(t):
    return t.training.select(*ID, F.col("gas_update_flag").cast("long").alias("gas_update_flag"), *s6(*MACRO_OUT))


@query(
    "e38_split_leak_check",
    """WITH c AS (SELECT ticker, dt AS last_input, min(dt) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS first_target FROM bars_v)
    SELECT ticker, count(*) AS n_rows, count(*) FILTER (WHERE first_target <= last_input) AS n_leaks FROM c GROUP BY ticker""",
)
def split_leak(t):
    c = panel.split_leak_check(t.bars.select(*ID))
    return c.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("first_target") <= F.col("last_input")).alias("n_leaks"))
