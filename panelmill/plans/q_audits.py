"""Compositions and audits a user calls (L)."""

from pyspark.sql import functions as F

from panelmill.functions.columns import snap
from panelmill.operators import audit, features, neardup, news, panel, stats
from panelmill.operators.features import TRAINING_FEATURES as FEATS
from panelmill.plans import config
from panelmill.plans.q_sets import MISSING
from panelmill.plans.q_stats import WEEK
from panelmill.plans.q_windows import frame
from panelmill.plans.registry import query
from panelmill.session import shared_folder
from panelmill.sources import tables as src


def s6(*names):
    return [snap(n).alias(n) for n in names]


def sql6(names):
    return ", ".join(f"SNAP6({n}) AS {n}" for n in names)


@query("l01_prepare_training", f"SELECT dt, ticker, sector, target_buffered, {sql6([c for c in FEATS if c != 'gas_update_flag'])}, gas_update_flag, SNAP6(close) AS close FROM training_v")
def l01(t):
    cols = [c for c in FEATS if c != "gas_update_flag"]
    return t.training.select("dt", "ticker", "sector", "target_buffered", *s6(*cols, "close"), F.col("gas_update_flag").cast("long").alias("gas_update_flag"))


LAG = features.LAGGED_BASE + [f"{c}_lag{k}" for k in (1, 2) for c in features.LAGGED_MEMORY]


@query("l02_prepare_lagged", f"SELECT dt, ticker, sector, target, {sql6(['close', *LAG])} FROM lagged_v")
def l02(t):
    return t.lagged.select("dt", "ticker", "sector", "target", *s6("close", *LAG))


@query(
    "l03_prepare_clean",
    f"""WITH b AS (SELECT *, ['{"','".join(config.TICKERS)}'][CAST(substr(ticker, 2) AS INT) % 8 + 1] AS entity FROM bars_v),
    j AS (SELECT b.*, direct_sentiment, sector_sentiment, direct_count, sector_count FROM b LEFT JOIN stock_day_v s ON s.dt = b.dt AND s.ticker = b.entity)
    SELECT dt, ticker, sector, SNAP6(close / lag(close) OVER w - 1) AS ret,
    CAST(CASE WHEN SNAP9(close / lag(close) OVER w - 1) > 0.005 THEN 1 WHEN SNAP9(close / lag(close) OVER w - 1) < -0.005 THEN 0 END AS BIGINT) AS target_buffered,
    SNAP6(open / close) AS open_close_ratio, SNAP6(high / low) AS high_low_ratio, SNAP6(volume / nullif(avg(volume) OVER f, 0)) AS vol_ma_ratio,
    CAST(CASE WHEN direct_count > 0 THEN 1 ELSE 0 END AS BIGINT) AS has_news, SNAP6(close) AS close, volume, SNAP6(direct_sentiment) AS direct_sentiment, SNAP6(sector_sentiment) AS sector_sentiment, direct_count, sector_count
    FROM j WINDOW w AS (PARTITION BY ticker ORDER BY dt), {frame(20)}""",
)
def l03(t):
    from panelmill.plans.q_tables import entity_bars

    linked = entity_bars(t).select("ticker", "dt", "entity")
    day = linked.join(t.stock_days.withColumnRenamed("ticker", "entity").drop("sector"), ["dt", "entity"], "inner").drop("entity")
    out = features.prepare_clean(t.bars, day)
    return out.select(
        "dt", "ticker", "sector", *s6("ret", "open_close_ratio", "high_low_ratio", "vol_ma_ratio", "close", "direct_sentiment", "sector_sentiment"),
        "target_buffered", "has_news", "volume", "direct_count", "sector_count",
    )


V1 = ["return_1d", "return_5d", "return_10d", "volatility_5d", "volatility_10d", "volatility_20d", "high_low_range", "close_open_ratio", "volume_ma_ratio_5", "volume_ma_ratio_10", "rsi_14", "close_norm_lag1", "close_norm_lag10", "volume_norm_lag1", "volume_norm_lag10"]


@query(
    "l04_daily_features_v1",
    f"""WITH r AS (SELECT *, close / lag(close) OVER w - 1 AS r1, coalesce(close - lag(close) OVER w, 0) AS delta FROM bars_v WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
    m AS (SELECT *, SNAP9(avg(greatest(delta, 0)) OVER f14) AS g, SNAP9(avg(greatest(-delta, 0)) OVER f14) AS l, count(*) OVER f14 AS c14,
      lag(close, 1) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 10) OVER w AS c10, lag(volume, 1) OVER w AS v1, lag(volume, 10) OVER w AS v10,
      {", ".join(f"CASE WHEN count(r1) OVER f{n} >= {max(3, n // 2)} THEN stddev_samp(r1) OVER f{n} END AS volatility_{n}d" for n in (5, 10, 20))},
      CASE WHEN count(r1) OVER f20 >= 10 THEN 3 * stddev_samp(r1) OVER f20 END AS band,
      {", ".join(f"CASE WHEN count(volume) OVER f{n} >= 2 THEN volume / nullif(avg(volume) OVER f{n}, 0) END AS volume_ma_ratio_{n}" for n in (5, 10))}
      FROM r WINDOW w AS (PARTITION BY ticker ORDER BY dt), {", ".join(frame(n, f"f{n}") for n in (5, 10, 14, 20))})
    SELECT ticker, dt, SNAP6(r1) AS return_1d, SNAP6(close / c5 - 1) AS return_5d, SNAP6(close / c10 - 1) AS return_10d, {sql6(["volatility_5d", "volatility_10d", "volatility_20d", "volume_ma_ratio_5", "volume_ma_ratio_10"])},
    SNAP6((high - low) / close) AS high_low_range, SNAP6(close / open) AS close_open_ratio, SNAP6(CASE WHEN c14 >= 14 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END END) AS rsi_14,
    CAST(CASE WHEN SNAP9(abs(r1)) > SNAP9(band) THEN 1 ELSE 0 END AS BIGINT) AS is_extreme_volatility,
    SNAP6(c1 / close) AS close_norm_lag1, SNAP6(c10 / close) AS close_norm_lag10, SNAP6(v1 / (volume + 1)) AS volume_norm_lag1, SNAP6(v10 / (volume + 1)) AS volume_norm_lag10 FROM m""",
)
def l04(t):
    return features.daily_features_v1(t.bars).select("ticker", "dt", *s6(*V1), "is_extreme_volatility")


V2 = ["ret_1w", "ret_2w", "ret_4w", "ret_8w", "ret_12w", "vol_4w", "vol_8w", "weekly_range", "volume_ratio_4w", "price_vs_ma4", "price_vs_ma8", "sp500_ret_1w", "oil_ret_4w", "usd_sell_rate_change_1w", "gold_24k_change_4w", "vix_change_1w", "vix_ma_ratio", "oil_gold_ratio", "real_rate", "rsi_4w"]
WK = "PARTITION BY ticker ORDER BY week"


def wk(n):
    return f"f{n} AS ({WK} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(
    "l05_weekly_features_v2",
    f"""WITH k AS ({WEEK}), d AS (SELECT DISTINCT week FROM k),
    s AS (SELECT coalesce(d.week, x.dt) AS day, d.week, x.* EXCLUDE (dt) FROM d FULL JOIN series_v x ON x.dt = d.week),
    f AS (SELECT week, {", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in ("usd_sell_rate", "gold_24k", "cbe_lending_rate", "headline_inflation", "oil", "gold_intl", "sp500", "vix"))} FROM s),
    j AS (SELECT k.*, f.* EXCLUDE (week), k.close / lag(k.close) OVER ({WK.replace('week', 'k.week')}) - 1 AS r1, coalesce(k.close - lag(k.close) OVER ({WK.replace('week', 'k.week')}), 0) AS delta FROM k JOIN f ON f.week = k.week),
    m AS (SELECT *, SNAP9(avg(greatest(delta, 0)) OVER f4) AS g, SNAP9(avg(greatest(-delta, 0)) OVER f4) AS l, count(*) OVER f4 AS c4, {", ".join(f"lag(close, {n}) OVER w AS c_{n}" for n in (2, 4, 8, 12))},
      {", ".join(f"CASE WHEN count(r1) OVER f{n} >= 2 THEN stddev_samp(r1) OVER f{n} END AS vol_{n}w, CASE WHEN count(close) OVER f{n} >= 2 THEN close / avg(close) OVER f{n} - 1 END AS price_vs_ma{n}" for n in (4, 8))},
      CASE WHEN count(volume) OVER f4 >= 2 THEN volume / nullif(avg(volume) OVER f4, 0) END AS volume_ratio_4w, lead(close) OVER w AS nx,
      lag(sp500) OVER w AS sp1, lag(oil, 4) OVER w AS oil4, lag(usd_sell_rate) OVER w AS usd1, lag(gold_24k, 4) OVER w AS gold4, lag(vix) OVER w AS vix1, CASE WHEN count(vix) OVER f4 >= 2 THEN vix / avg(vix) OVER f4 END AS vix_ma_ratio
      FROM j WINDOW w AS ({WK}), {wk(4)}, {wk(8)})
    SELECT ticker, week, SNAP6(r1) AS ret_1w, {", ".join(f"SNAP6(close / c_{n} - 1) AS ret_{n}w" for n in (2, 4, 8, 12))}, {sql6(["vol_4w", "vol_8w", "price_vs_ma4", "price_vs_ma8", "volume_ratio_4w", "vix_ma_ratio"])},
    SNAP6((high - low) / close) AS weekly_range, SNAP6(sp500 / sp1 - 1) AS sp500_ret_1w, SNAP6(oil / oil4 - 1) AS oil_ret_4w, SNAP6(usd_sell_rate / usd1 - 1) AS usd_sell_rate_change_1w,
    SNAP6(gold_24k / gold4 - 1) AS gold_24k_change_4w, SNAP6(vix / vix1 - 1) AS vix_change_1w, SNAP6(oil / gold_intl) AS oil_gold_ratio, SNAP6(cbe_lending_rate - headline_inflation) AS real_rate,
    SNAP6(CASE WHEN c4 >= 4 THEN CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100 END END) AS rsi_4w, CAST(CASE WHEN nx > close THEN 1 ELSE 0 END AS BIGINT) AS target FROM m""",
)
def l05(t):
    weekly = panel.resample_weekly(t.bars)
    series = panel.merge_series(t.macro, t.globals).withColumnRenamed("dt", "week")
    return features.weekly_features_v2(panel.asof_macro(weekly, series, "week")).select("ticker", "week", *s6(*V2), "target")


@query(
    "l06_quality_audit",
    f"""WITH a AS (SELECT greatest({", ".join(f"coalesce(abs(corr({c}, target_buffered)), 0)" for c in FEATS)}, 0) AS worst, avg(target_buffered) AS rate,
      {" + ".join(f"CASE WHEN min({c}) < 0.01 OR max({c}) > 100 THEN 1 ELSE 0 END" for c in audit.RATIO_COLUMNS)} AS outside FROM training_v),
    h AS (SELECT count(*) AS unhealthy FROM (SELECT ticker FROM training_v GROUP BY ticker HAVING count(*) < 1000))
    SELECT 'leakage' AS "check", SNAP6(worst) AS value, CASE WHEN worst <= 0.95 THEN 'PASS' ELSE 'FAIL' END AS status FROM a
    UNION ALL SELECT 'class_balance', SNAP6(rate), CASE WHEN rate BETWEEN 0.1 AND 0.9 THEN 'PASS' ELSE 'WARN' END FROM a
    UNION ALL SELECT 'key_health', unhealthy, CASE WHEN unhealthy = 0 THEN 'PASS' ELSE 'WARN' END FROM h
    UNION ALL SELECT 'ratio_ranges', outside, CASE WHEN outside = 0 THEN 'PASS' ELSE 'WARN' END FROM a
    UNION ALL SELECT 'forbidden_columns', 0, 'PASS' UNION ALL SELECT 'verdict', NULL, CASE WHEN worst <= 0.95 THEN 'GO' ELSE 'NO-GO' END FROM a""",
)
def l06(t):
    return audit.quality_audit(t.training, FEATS)


@query(
    "l07_final_audit",
    f"""WITH a AS (SELECT avg(CASE WHEN abs(gas_return) < 1e-4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS zeros, count(*) FILTER (WHERE NOT abs(gas_return) < 1e-4) AS spikes,
      corr(usd_return_daily, gold_return_daily) AS c, CASE WHEN max(gdp_growth) > 1 THEN 1 ELSE 0 END + CASE WHEN max(cbe_lending_rate) > 100 THEN 1 ELSE 0 END
      + {" + ".join(f"CASE WHEN max({c}) > 1 OR min({c}) < -1 THEN 1 ELSE 0 END" for c in audit.RETURN_COLUMNS)} AS issues FROM training_v)
    SELECT 'required_columns' AS "check", 0.0::DOUBLE AS value, 'PASS' AS status UNION ALL SELECT 'gas_zero_share', SNAP6(zeros), CASE WHEN zeros >= 0.95 THEN 'PASS' ELSE 'WARN' END FROM a
    UNION ALL SELECT 'gas_spikes', spikes, 'INFO' FROM a UNION ALL SELECT 'fx_gold_corr', SNAP6(c), CASE WHEN abs(c) > 0.999 THEN 'FAIL' WHEN abs(c) > 0.9 THEN 'WARN' ELSE 'PASS' END FROM a
    UNION ALL SELECT 'scale_issues', issues, CASE WHEN issues = 0 THEN 'PASS' ELSE 'WARN' END FROM a UNION ALL SELECT 'forbidden_columns', 0, 'PASS'
    UNION ALL SELECT 'verdict', NULL, CASE WHEN zeros >= 0.95 AND abs(c) <= 0.999 AND issues = 0 THEN 'READY' ELSE 'REVIEW' END FROM a""",
)
def l07(t):
    return audit.final_audit(t.training)


BARCOLS = ["ticker", "dt", "isin", "sector", "open", "high", "low", "close", "volume"]
MACROCOLS = ["dt", "usd_sell_rate", "gold_24k", "gasoline_92", "cbe_lending_rate", "headline_inflation", "gdp_usd_billion"]


def nulls_sql(cols):
    return " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)


@query(
    "l08_integrity_audit",
    f"""WITH b AS (SELECT *, date_diff('day', lag(dt) OVER (PARTITION BY ticker ORDER BY dt), dt) AS gap FROM bars_v),
    x AS (SELECT {nulls_sql(BARCOLS)} AS n, count(*) FILTER (WHERE high < low OR close < 0) AS i, count(*) FILTER (WHERE gap > 5) AS g, max(gap) AS m FROM b),
    c AS (SELECT *, date_diff('day', lag(dt) OVER (ORDER BY dt), dt) AS gap FROM macro_v),
    y AS (SELECT {nulls_sql(MACROCOLS)} AS n, count(*) FILTER (WHERE gap > 1) AS g, max(gap) AS m FROM c),
    z AS (SELECT count(*) FILTER (WHERE title IS NOT NULL) AS v, count(*) FILTER (WHERE title IS NULL) AS i, count(*) - count(DISTINCT url) AS d FROM articles_v),
    s AS (SELECT CASE WHEN sum(direct_sentiment) = 0 THEN 1 ELSE 0 END + CASE WHEN sum(sector_sentiment) = 0 THEN 1 ELSE 0 END AS q FROM stock_day_v),
    r AS (SELECT 'bars_nulls' AS "check", n AS value, 'WARN' AS bad FROM x UNION ALL SELECT 'bars_invalid_prices', i, 'FAIL' FROM x UNION ALL SELECT 'bars_gaps', g, 'WARN' FROM x UNION ALL SELECT 'bars_max_gap', m, 'INFO' FROM x
      UNION ALL SELECT 'macro_nulls', n, 'WARN' FROM y UNION ALL SELECT 'macro_gaps', g, 'WARN' FROM y UNION ALL SELECT 'macro_max_gap', m, 'INFO' FROM y
      UNION ALL SELECT 'articles_valid', v, 'INFO' FROM z UNION ALL SELECT 'articles_invalid', i, 'WARN' FROM z UNION ALL SELECT 'articles_duplicate_urls', d, 'WARN' FROM z UNION ALL SELECT 'all_zero_sentiment', q, 'WARN' FROM s)
    SELECT "check", CAST(value AS DOUBLE) AS value, CASE WHEN bad = 'INFO' THEN 'INFO' WHEN value = 0 THEN 'PASS' ELSE bad END AS status FROM r""",
)
def l08(t):
    return audit.integrity_audit(t.bars, t.macro, t.articles, t.stock_days)


@query(
    "l09_gap_audit",
    MISSING.replace("{start}", "greatest(f, l - 30)")
    + """, c2 AS (SELECT ticker, count(*) AS n FROM m GROUP BY ticker), r AS (SELECT ticker, max(dt) AS "last", count(*) FILTER (WHERE dt >= (SELECT max(dt) FROM bars_v) - 30) AS n_recent FROM bars_v GROUP BY ticker)
    SELECT r.ticker, "last", n_recent, coalesce(n, 0) AS n_missing, CASE WHEN coalesce(n, 0) = 0 THEN 'COMPLETE' WHEN n_recent > 0 THEN 'GAPS' ELSE 'SILENT' END AS status FROM r LEFT JOIN c2 ON c2.ticker = r.ticker""",
)
def l09(t):
    return audit.gap_audit(t.bars)


@query(
    "l10_leak_audit",
    """WITH f AS (SELECT dt AS i, min(dt) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS o FROM bars_v),
    s AS (SELECT ticker, max(dt) FILTER (WHERE split = 'train') AS a, min(dt) FILTER (WHERE split = 'val') AS b, max(dt) FILTER (WHERE split = 'val') AS c, min(dt) FILTER (WHERE split = 'test') AS d FROM split_v GROUP BY ticker),
    r AS (SELECT 'input_before_target' AS "check", count(*) FILTER (WHERE o <= i) AS n FROM f UNION ALL SELECT 'splits_in_order', count(*) FILTER (WHERE a >= b OR c >= d OR a >= d) FROM s
      UNION ALL SELECT 'train_only_statistics', count(*) FILTER (WHERE sd IS NULL) FROM (SELECT ticker, stddev_samp(ret_w1_mean) AS sd FROM split_v WHERE split = 'train' GROUP BY ticker))
    SELECT "check", CAST(n AS DOUBLE) AS value, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""",
)
def l10(t):
    return audit.leak_audit(t.samples, t.bars, "ret_w1_mean")


@query(
    "l11_data_health",
    """WITH m AS (SELECT ticker, dt, SNAP9(close / lag(close) OVER (PARTITION BY ticker ORDER BY dt) - 1) AS v FROM bars_v), q AS (SELECT * FROM m WHERE v IS NOT NULL)
    SELECT * FROM (SELECT 'drop' AS kind, ticker, dt, SNAP6(v) AS value FROM q ORDER BY v, ticker, dt LIMIT 3) UNION ALL SELECT * FROM (SELECT 'gain', ticker, dt, SNAP6(v) FROM q ORDER BY v DESC, ticker, dt LIMIT 3)
    UNION ALL SELECT 'close_below_0.01', NULL, NULL, count(*) FILTER (WHERE close < 0.01) FROM bars_v UNION ALL SELECT 'close_null', NULL, NULL, count(*) FILTER (WHERE close IS NULL) FROM bars_v
    UNION ALL SELECT 'has_usd_sell_rate', NULL, NULL, CASE WHEN count(usd_sell_rate) > 0 THEN 1 ELSE 0 END FROM macro_v UNION ALL SELECT 'has_gold_24k', NULL, NULL, CASE WHEN count(gold_24k) > 0 THEN 1 ELSE 0 END FROM macro_v
    UNION ALL SELECT 'has_gasoline_92', NULL, NULL, CASE WHEN count(gasoline_92) > 0 THEN 1 ELSE 0 END FROM macro_v""",
)
def l11(t):
    return audit.data_health(t.bars, t.macro)


def new_articles(t):
    """Relevant articles whose URL is not in the older part of the store."""
    relevant = t.articles.filter(news.match_any_keyword(F.col("text"), config.KEYWORDS))
    return panel.only_new(relevant, t.articles.filter("dt < DATE '1996-03-01'"), "url")


KW = " OR ".join(f"contains(lower(text), '{k.lower()}')" for k in config.KEYWORDS)


@query(
    "l12_news_flow",
    f"""WITH n AS (SELECT seq, dt, CASE lex_label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS score FROM lex_v WHERE ({KW}) AND url NOT IN (SELECT url FROM articles_v WHERE dt < DATE '1996-03-01')),
    g AS (SELECT DISTINCT n.dt, e.ticker, e.sector FROM n CROSS JOIN entity_v e),
    d AS (SELECT n.dt, x.ticker, avg(score) AS m, count(*) AS c FROM n JOIN direct_v x ON x.seq = n.seq GROUP BY 1, 2), p AS (SELECT n.dt, x.ticker, avg(score) AS m, count(*) AS c FROM n JOIN peer_v x ON x.seq = n.seq GROUP BY 1, 2)
    SELECT g.dt, g.ticker, g.sector, SNAP6(coalesce(d.m, 0)) AS direct_sentiment, SNAP6(coalesce(p.m, 0)) AS sector_sentiment, coalesce(d.c, 0) AS direct_count, coalesce(p.c, 0) AS sector_count
    FROM g LEFT JOIN d ON d.dt = g.dt AND d.ticker = g.ticker LEFT JOIN p ON p.dt = g.dt AND p.ticker = g.ticker""",
)
def l12(t):
    from panelmill.functions.columns import sentiment_score

    labelled = news.lexicon_sentiment(new_articles(t), config.LEXICON)
    days = news.stock_day_sentiment(labelled, config.ALIASES, config.SECTOR_MAP, sentiment_score("lex_label"))
    return days.select("dt", "ticker", "sector", *s6("direct_sentiment", "sector_sentiment"), "direct_count", "sector_count")


@query("l13_dedupe_news")
def l13(t):
    by_url = news.dedupe_url(t.articles)
    kept = neardup.dedupe_titles(by_url, sequence="first_seq")
    n = lambda df, step: df.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"))
    return n(t.articles, "original").union(n(by_url, "unique url")).union(n(kept, "unique title"))


@query("l14_ingest_bars", "SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_keys, min(dt) AS \"first\", max(dt) AS \"last\", SNAP6(sum(volume)) AS volume FROM bars_v")
def l14(t):
    root = shared_folder(t.spark, "ingest")
    old = t.bars.filter("dt < DATE '1997-01-01'")
    src.append_rows(old.withColumn("load_seq", F.lit(1)), root, "parquet")
    store = t.spark.read.parquet(root)
    src.append_rows(panel.after_high_water(t.bars, store).withColumn("load_seq", F.lit(2)), root, "parquet")
    clean = panel.dedupe_keep_last(t.spark.read.parquet(root), ["ticker", "dt"], "load_seq")
    total = clean.agg(F.sum("volume").cast("double")).scalar()
    return stats.table_profile(clean).withColumn("volume", snap(total))
