"""Aggregations and statistics (D)."""

from itertools import combinations

from pyspark.sql import functions as F

from panelmill.functions.columns import apply_threshold, feature_category, relative_lift, significant, snap, squared_loss
from panelmill.operators import causality, features, models, news, panel, splits, stats
from panelmill.operators.features import TRAINING_FEATURES as FEATS
from panelmill.plans import config
from panelmill.plans.registry import query

BARS = ["open", "high", "low", "close", "volume"]


def s6(*names):
    return [snap(n).alias(n) for n in names]


@query("d01_daily_sentiment", "SELECT dt, SNAP6(avg(lex_score)) AS score FROM lex_v GROUP BY dt")
def daily_sentiment(t):
    return news.lexicon_sentiment(t.articles, config.LEXICON).groupBy("dt").agg(snap(F.avg("lex_score")).alias("score"))


@query("d02_daily_features", "SELECT dt, SNAP6(avg(score)) AS mean_score, count(*) AS n_articles FROM scored_v GROUP BY dt")
def daily_features(t):
    from panelmill.functions.columns import sentiment_score

    s = t.articles.withColumn("score", sentiment_score(F.coalesce("sentiment", F.lit(""))))
    return s.groupBy("dt").agg(snap(F.avg("score")).alias("mean_score"), F.count(F.lit(1)).alias("n_articles"))


@query(
    "d03_stock_day_sentiment",
    "SELECT dt, ticker, sector, SNAP6(direct_sentiment) AS direct_sentiment, SNAP6(sector_sentiment) AS sector_sentiment, direct_count, sector_count FROM stock_day_v",
)
def stock_day_sentiment(t):
    return t.stock_days.select("dt", "ticker", "sector", *s6("direct_sentiment", "sector_sentiment"), "direct_count", "sector_count")


@query(
    "d04_value_distribution",
    "SELECT sentiment, count(*) AS n, SNAP6(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM articles_v) * 100) AS pct FROM articles_v GROUP BY sentiment",
)
def value_distribution(t):
    return stats.value_distribution(t.articles, "sentiment")


@query("d05_table_profile", 'SELECT count(*) AS n_rows, count(DISTINCT ticker) AS n_keys, min(dt) AS "first", max(dt) AS "last" FROM bars_v')
def table_profile(t):
    return stats.table_profile(t.bars)


@query("d06_last_date_per_key", 'SELECT ticker, max(dt) AS "last" FROM bars_v GROUP BY ticker')
def last_date(t):
    return stats.last_date_per_key(t.bars)


SERIES = ["usd_sell_rate", "gold_24k", "cbe_lending_rate", "headline_inflation", "oil", "vix"]


@query(
    "d07_null_counts",
    "WITH x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM series_v" for c in SERIES)
    + ") SELECT * FROM x UNION ALL SELECT '*', CAST(sum(n_null) AS BIGINT) FROM x",
)
def null_counts(t):
    return stats.null_counts(panel.merge_series(t.macro, t.globals), SERIES)


WEEK = """SELECT ticker, CAST(dt + CAST((12 - dayofweek(dt)) % 7 AS INT) AS DATE) AS week, arg_min(open, dt) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, dt) AS close, CAST(sum(volume) AS BIGINT) AS volume, arg_min(sector, dt) AS sector, arg_min(isin, dt) AS isin FROM bars_v GROUP BY 1, 2"""


@query("d08_resample_weekly", f"SELECT ticker, week, SNAP6(open) AS open, SNAP6(high) AS high, SNAP6(low) AS low, SNAP6(close) AS close, volume, sector, isin FROM ({WEEK})")
def resample_weekly(t):
    return panel.resample_weekly(t.bars).select("ticker", "week", *s6("open", "high", "low", "close"), "volume", "sector", "isin")


PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM training_v" for a, b in combinations(FEATS, 2))


@query("d09_correlation_matrix", f"SELECT feature_a, feature_b, SNAP6(CASE WHEN isnan(corr) THEN NULL ELSE corr END) AS corr FROM ({PAIRS})")
def correlation_matrix(t):
    return stats.correlation_pairs(t.training, FEATS).withColumn("corr", snap("corr"))


SAMPLE_FEATS = ["ret_w0_mean", "ret_w1_mean", "ret_w0_std", "ret_w1_std", "cumret_w0", "cumret_w1", "macro_usd_egp_change"]
BPAIRS = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, abs(corr({a}, {b})) AS abs_corr FROM bars_v" for a, b in combinations(BARS, 2))


@query("d10_correlated_pairs", f"SELECT feature_a, feature_b, SNAP6(abs_corr) AS abs_corr FROM ({BPAIRS}) WHERE abs_corr > 0.85")
def correlated_pairs(t):
    return stats.correlated_pairs(t.bars, BARS).withColumn("abs_corr", snap("abs_corr"))


TCORR = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, target_buffered) AS corr FROM training_v" for c in FEATS)


@query("d11_target_correlation", f"SELECT feature, SNAP6(corr) AS corr, coalesce(abs(corr) > 0.95, false) AS leaks FROM ({TCORR})")
def target_correlation(t):
    return stats.target_correlation(t.training, FEATS, "target_buffered").withColumn("corr", snap("corr"))


@query("d13_key_health", "SELECT ticker, count(*) AS n_rows, count(*) >= 1000 AS healthy FROM training_v GROUP BY ticker")
def key_health(t):
    return stats.key_health(t.training)


@query("d14_percentile_threshold", "SELECT ticker, SNAP6(quantile_cont(p_endo, 0.4)) AS threshold FROM score_v WHERE split = 'val' GROUP BY ticker")
def percentile_threshold(t):
    return stats.percentile_threshold(t.scores.filter("split = 'val'"), "p_endo").withColumn("threshold", snap("threshold"))


@query(
    "d15_fill_median",
    "SELECT dt, SNAP6(coalesce(oil, (SELECT quantile_cont(oil, 0.5) FROM series_v))) AS oil FROM series_v",
)
def fill_median(t):
    return features.fill_median(panel.merge_series(t.macro, t.globals).select("dt", "oil"), ["oil"]).withColumn("oil", snap("oil"))


RATIOS = ["open_close_ratio", "high_low_ratio", "volume_relative_20"]


@query(
    "d16_range_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", SNAP6(min({c})) AS \"min\", SNAP6(max({c})) AS \"max\", SNAP6(avg({c})) AS mean, SNAP6(stddev_samp({c})) AS std, min({c}) < 0.01 OR max({c}) > 100 AS suspicious FROM training_v"
        for c in RATIOS
    ),
)
def range_audit(t):
    out = stats.range_audit(t.training, RATIOS, 0.01, 100.0)
    return out.select("column", *s6("min", "max", "mean", "std"), "suspicious")


@query(
    "d17_sparsity_audit",
    """SELECT count(*) FILTER (WHERE abs(gas_return) < 1e-4) AS n_zero, count(*) FILTER (WHERE NOT abs(gas_return) < 1e-4) AS n_spike,
    SNAP6(avg(CASE WHEN abs(gas_return) < 1e-4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS zero_share,
    avg(CASE WHEN abs(gas_return) < 1e-4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) >= 0.95 AS passed FROM training_v""",
)
def sparsity_audit(t):
    return stats.sparsity_audit(t.training, "gas_return").withColumn("zero_share", snap("zero_share"))


@query(
    "d18_separation_audit",
    """SELECT SNAP6(corr(usd_return_daily, gold_return_daily)) AS corr, CASE WHEN abs(corr(usd_return_daily, gold_return_daily)) > 0.999 THEN 'FAIL'
    WHEN abs(corr(usd_return_daily, gold_return_daily)) > 0.9 THEN 'WARN' ELSE 'PASS' END AS status FROM training_v""",
)
def separation_audit(t):
    return stats.separation_audit(t.training, "usd_return_daily", "gold_return_daily").withColumn("corr", snap("corr"))


@query(
    "d19_unit_scale",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", SNAP6(max({c})) AS \"max\", CASE WHEN max({c}) <= 1 THEN 'decimal' WHEN max({c}) <= 100 THEN 'percentage' ELSE 'unknown' END AS scale FROM macro_v"
        for c in ("cbe_lending_rate", "headline_inflation", "gdp_usd_billion")
    ),
)
def unit_scale(t):
    return stats.unit_scale(t.macro, ["cbe_lending_rate", "headline_inflation", "gdp_usd_billion"]).withColumn("max", snap("max"))


SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    "d20_pivot_mean",
    "SELECT ticker, " + ", ".join(f"SNAP6(avg(p_endo) FILTER (WHERE split = '{s}')) AS {s}" for s in ("train", "val", "test")) + " FROM score_v WHERE split IS NOT NULL GROUP BY ticker",
)
def pivot_mean(t):
    out = stats.pivot_mean(t.scores.filter("split IS NOT NULL"), "ticker", "split", ["train", "val", "test"], "p_endo")
    return out.select("ticker", *s6("train", "val", "test"))


@query(
    "d21_group_summary",
    """SELECT coalesce(sector, '*') AS sector, count(*) AS n_tickers, SNAP6(avg(f1_lift)) AS mean_lift, SNAP6(avg(CASE WHEN significant THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS share_significant
    FROM report_v GROUP BY ROLLUP (sector)""",
)
def group_summary(t):
    r = models.compare_feature_sets(t.scores)
    out = r.rollup("sector").agg(
        F.count(F.lit(1)).alias("n_tickers"), snap(F.avg("f1_lift")).alias("mean_lift"),
        snap(F.avg(F.when(F.col("significant"), 1.0).otherwise(0.0))).alias("share_significant"),
    )
    return out.withColumn("sector", F.coalesce("sector", F.lit("*")))


@query(
    "d22_best_per_key",
    "SELECT sector, ticker, SNAP6(exo_f1) AS exo_f1 FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY SNAP9(exo_f1) DESC, ticker) AS rn FROM report_v) WHERE rn = 1",
)
def best_per_key(t):
    r = models.compare_feature_sets(t.scores).select("sector", "ticker", snap("exo_f1", 9).alias("exo_f1"))
    return stats.best_per_key(r, "sector", "exo_f1", "ticker").withColumn("exo_f1", snap("exo_f1"))


EDGES = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 1.01]


@query(
    "d23_fixed_bins",
    " UNION ALL ".join(
        f"SELECT CAST({lo} AS DOUBLE) AS lo, CAST({hi} AS DOUBLE) AS hi, count(*) FILTER (WHERE p_endo >= CAST({lo} AS DOUBLE) AND p_endo < CAST({hi} AS DOUBLE)) AS n FROM score_v"
        for lo, hi in zip(EDGES, EDGES[1:])
    ),
)
def fixed_bins(t):
    return stats.fixed_bins(t.scores, "p_endo", EDGES)


@query(
    "d24_fit_zscore",
    "SELECT ticker, " + ", ".join(f"SNAP6(avg({c})) AS {c}_mu, SNAP6(CASE WHEN SNAP9(stddev_samp({c})) = 0 THEN 1 ELSE stddev_samp({c}) END) AS {c}_sigma" for c in SAMPLE_FEATS[:4])
    + " FROM split_v WHERE split = 'train' GROUP BY ticker",
)
def fit_zscore(t):
    out = splits.fit_zscore(splits.purged_split(t.samples).filter("split = 'train'"), SAMPLE_FEATS[:4])
    return out.select("ticker", *s6(*[f"{c}_{k}" for c in SAMPLE_FEATS[:4] for k in ("mu", "sigma")]))


@query(
    "d25_binary_metrics",
    """WITH c AS (SELECT ticker, count(*) FILTER (WHERE y = 1 AND p_endo >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p_endo >= 0.5) AS fp,
    count(*) FILTER (WHERE y = 1 AND p_endo < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p_endo < 0.5) AS tn FROM score_v WHERE split = 'test' GROUP BY ticker)
    SELECT *, SNAP6(coalesce(tp / nullif(tp + fp, 0), 0)) AS "precision", SNAP6(coalesce(tp / nullif(tp + fn, 0), 0)) AS recall,
    SNAP6(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1, SNAP6((tp + tn) / (tp + fp + fn + tn)) AS accuracy FROM c""",
)
def binary_metrics(t):
    df = t.scores.filter("split = 'test'").withColumn("yhat", apply_threshold("p_endo", F.lit(0.5)))
    return stats.binary_metrics(df, "y", "yhat", "ticker").select("ticker", "tp", "fp", "fn", "tn", *s6("precision", "recall", "f1", "accuracy"))


@query("d26_roc_auc", "SELECT ticker, SNAP6(endo_auc) AS auc FROM auc_v")
def roc_auc(t):
    return stats.roc_auc(t.scores.filter("split = 'test'"), "y", "p_endo", "ticker").withColumn("auc", snap("auc"))


MI_FEATS = SAMPLE_FEATS


def mi_sql(columns, source, target, bins=10):
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, {target} AS y FROM {source}" for c in columns)
    return f"""l AS (SELECT * FROM ({long}) WHERE x IS NOT NULL), b AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
    c AS (SELECT l.feature, y, coalesce(least(floor(SNAP9((x - lo) / nullif(hi - lo, 0)) * {bins}), {bins - 1}), 0) AS cell FROM l JOIN b ON l.feature = b.feature),
    g AS (SELECT feature, cell, y, CAST(count(*) AS DOUBLE) AS n FROM c GROUP BY 1, 2, 3),
    h AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, cell) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM g),
    mi AS (SELECT feature, sum(n / nn * ln(n * nn / (nx * ny))) AS importance FROM h GROUP BY feature)"""


@query("d27_mutual_information", f"WITH {mi_sql(MI_FEATS, 'samples_v', 'target')} SELECT feature, SNAP6(importance) AS importance FROM mi")
def mutual_information(t):
    return stats.mutual_information(t.samples, MI_FEATS, "target").withColumn("importance", snap("importance"))


@query("d28_diebold_mariano", "SELECT ticker, n_test AS n, SNAP6(dm) AS dm FROM dm_v")
def diebold_mariano(t):
    return stats.diebold_mariano(t.scores.filter("split = 'test'"), squared_loss("y", "p_endo"), squared_loss("y", "p_exo")).withColumn("dm", snap("dm"))


@query(
    "d28b_diebold_mariano_h3",
    """WITH d AS (SELECT ticker, dt, (y - p_endo) * (y - p_endo) - (y - p_exo) * (y - p_exo) AS d FROM score_v WHERE split = 'test'),
    l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
    a AS (SELECT ticker, count(*) AS n, avg(d) AS db, var_samp(d) AS g0, covar_samp(d, d1) AS g1, covar_samp(d, d2) AS g2 FROM l GROUP BY ticker),
    v AS (SELECT *, (g0 + coalesce(CAST(2 * (1 - 1 / 3.0::DOUBLE) AS DOUBLE) * g1, 0) + coalesce(CAST(2 * (1 - 2 / 3.0::DOUBLE) AS DOUBLE) * g2, 0)) / n AS v FROM a)
    SELECT ticker, n, SNAP6(CASE WHEN n >= 10 AND v > 0 THEN db / sqrt(v) END) AS dm FROM v""",
)
def diebold_mariano_h3(t):
    out = stats.diebold_mariano(t.scores.filter("split = 'test'"), squared_loss("y", "p_endo"), squared_loss("y", "p_exo"), h=3)
    return out.withColumn("dm", snap("dm"))


@query(
    "d29_is_significant",
    """SELECT ticker, n_test AS n, SNAP6(dm) AS dm, coalesce(abs(SNAP6(dm)) > (1.959964 + (1.959964::DOUBLE ** 3 + 1.959964) / 4 / (n_test - 1)
    + (5 * 1.959964::DOUBLE ** 5 + 16 * 1.959964::DOUBLE ** 3 + 3 * 1.959964) / 96 / ((n_test - 1) * (n_test - 1))), false) AS is_significant FROM dm_v""",
)
def is_significant(t):
    from panelmill.functions.columns import t_critical_95

    out = stats.diebold_mariano(t.scores.filter("split = 'test'"), squared_loss("y", "p_endo"), squared_loss("y", "p_exo")).withColumn("dm", snap("dm"))
    return out.withColumn("is_significant", F.coalesce(F.abs("dm") > t_critical_95(F.col("n") - 1), F.lit(False)))


@query("d29b_p_value_t")
def p_value(t):
    out = stats.diebold_mariano(t.scores.filter("split = 'test'"), squared_loss("y", "p_endo"), squared_loss("y", "p_exo"))
    return out.withColumn("p_value", snap(stats.p_value_t("dm", F.col("n") - 1)))


BUY = "SELECT * FROM score_v WHERE split = 'test' AND p_endo >= 0.5 AND fwd_ret IS NOT NULL"


@query(
    "d30_annualized_sharpe",
    f"""SELECT ticker, count(*) AS n, SNAP6(CASE WHEN count(*) >= 10 AND SNAP9(stddev_pop(fwd_ret)) > 0 THEN avg(fwd_ret) / stddev_pop(fwd_ret) * sqrt(252) ELSE -999 END) AS sharpe
    FROM ({BUY}) GROUP BY ticker""",
)
def annualized_sharpe(t):
    return stats.annualized_sharpe(t.scores.filter("split = 'test' AND p_endo >= 0.5 AND fwd_ret IS NOT NULL"), "fwd_ret", "ticker").withColumn("sharpe", snap("sharpe"))


@query(
    "d31_cagr",
    f"""SELECT ticker, count(*) AS n, SNAP6(CASE WHEN min(1 + fwd_ret) <= 0 THEN -1 ELSE exp(sum(CASE WHEN 1 + fwd_ret > 0 THEN ln(1 + fwd_ret) END) * 252 / count(*)) - 1 END / 1000000) AS cagr_millions
    FROM (SELECT *, fwd_ret / 100 AS x FROM ({BUY})) GROUP BY ticker""".replace("fwd_ret)", "x)").replace("1 + fwd_ret", "1 + x"),
)
def cagr(t):
    df = t.scores.filter("split = 'test' AND p_endo >= 0.5 AND fwd_ret IS NOT NULL").withColumn("x", F.col("fwd_ret") / 100)
    return stats.cagr(df, "x", "ticker").select("ticker", "n", snap(F.col("cagr") / 1000000).alias("cagr_millions"))


@query("d34_duplicate_count", """SELECT count(*) FILTER (WHERE sentiment IS NOT NULL) AS n_valid, count(*) FILTER (WHERE sentiment IS NULL) AS n_invalid,
    count(*) FILTER (WHERE sentiment IS NOT NULL) - count(DISTINCT CASE WHEN sentiment IS NOT NULL THEN url END) AS n_duplicate FROM articles_v""")
def duplicate_count(t):
    return stats.duplicate_count(t.articles, "url", news.valid_article("title", "url", "sentiment"))


DAY_COLS = ["direct_sentiment", "sector_sentiment", "direct_count", "sector_count"]


@query(
    "d35_all_zero_columns",
    "WITH x AS (SELECT *, 0 AS blank_sentiment FROM stock_day_v) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM x HAVING sum(abs({c})) = 0" for c in [*DAY_COLS, "blank_sentiment"]),
)
def all_zero(t):
    return stats.all_zero_columns(t.stock_days.withColumn("blank_sentiment", F.lit(0)), [*DAY_COLS, "blank_sentiment"])


@query("d36_win_rate", f"SELECT ticker, SNAP6(avg(CASE WHEN fwd_ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS win_rate FROM ({BUY}) GROUP BY ticker")
def win_rate(t):
    return stats.win_rate(t.scores.filter("split = 'test' AND p_endo >= 0.5 AND fwd_ret IS NOT NULL"), "fwd_ret", "ticker").withColumn("win_rate", snap("win_rate"))


@query("d37_sharpe_threshold_sweep", "SELECT ticker, SNAP6(threshold) AS threshold, SNAP6(best_sharpe) AS best_sharpe FROM sweep_v")
def threshold_sweep(t):
    out = stats.sharpe_threshold_sweep(t.scores.filter("split = 'val'"), "p_endo", "fwd_ret")
    return out.select("ticker", *s6("threshold", "best_sharpe"))


@query(
    "d38_relative_lift",
    """SELECT ticker, SNAP6(CASE WHEN endo_f1 = 0 THEN 0 ELSE (exo_f1 - endo_f1) / endo_f1 END) AS lift_zero,
    SNAP6(CASE WHEN endo_f1 = 0 THEN NULL ELSE (exo_f1 - endo_f1) / endo_f1 * 100 END) AS lift_pct FROM report_v""",
)
def lift(t):
    r = models.compare_feature_sets(t.scores)
    return r.select("ticker", snap(relative_lift("endo_f1", "exo_f1")).alias("lift_zero"), snap(relative_lift("endo_f1", "exo_f1", "null", 100.0)).alias("lift_pct"))


@query(
    "d39_category_summary",
    f"""WITH {mi_sql(MI_FEATS, 'samples_v', 'target')} SELECT CASE WHEN feature LIKE 'price\\_%' ESCAPE '\\' THEN 'Price' WHEN feature LIKE 'tech\\_%' ESCAPE '\\' THEN 'Technical'
    WHEN feature LIKE 'macro\\_%' ESCAPE '\\' THEN 'Macro' ELSE 'Other' END AS category, SNAP6(avg(importance)) AS mean_importance, count(*) AS n_features FROM mi GROUP BY 1""",
)
def category_summary(t):
    mi = stats.mutual_information(t.samples, MI_FEATS, "target")
    return stats.category_summary(mi, feature_category("feature")).withColumn("mean_importance", snap("mean_importance"))


METRICS = ["endo_f1", "exo_f1", "endo_auc", "exo_auc", "f1_lift"]


@query(
    "d40_metric_summary",
    " UNION ALL ".join([f"SELECT '{m}' AS metric, SNAP6(avg({m})) AS mean, SNAP6(stddev_samp({m})) AS std FROM report_v" for m in METRICS])
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{f}', SNAP6(avg(CASE WHEN {f} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)), NULL FROM report_v" for f in ("exo_better", "significant")),
)
def metric_summary(t):
    out = stats.metric_summary(models.compare_feature_sets(t.scores), METRICS, ["exo_better", "significant"])
    return out.select("metric", *s6("mean", "std"))


@query("d41_positive_rate", "SELECT ticker, SNAP6(avg(target)) AS positive_rate FROM split_v WHERE split = 'train' GROUP BY ticker")
def positive_rate(t):
    return stats.positive_rate(splits.purged_split(t.samples).filter("split = 'train'"), "target").withColumn("positive_rate", snap("positive_rate"))


@query(
    "d32_granger_lag1",
    """WITH d AS (SELECT sector, dt, score, close, lag(score) OVER w AS x1, lag(close) OVER w AS y1 FROM sector_news_v WINDOW w AS (PARTITION BY sector ORDER BY dt)),
    m AS (SELECT sector, count(*) AS n, var_pop(close) AS yy, var_pop(y1) AS aa, var_pop(x1) AS bb, covar_pop(close, y1) AS ya, covar_pop(close, x1) AS yb, covar_pop(y1, x1) AS ab
          FROM d WHERE x1 IS NOT NULL GROUP BY sector),
    s AS (SELECT *, yy - ya * ya / nullif(aa, 0) AS sr, yy - (ya * ya * bb - 2 * ya * yb * ab + yb * yb * aa) / nullif(aa * bb - ab * ab, 0) AS su FROM m)
    SELECT sector, n, SNAP6(n * (sr - su) / nullif(su, 0)) AS chi2, coalesce(n * (sr - su) / nullif(su, 0) > 3.841459, false) AS is_significant FROM s""",
)
def granger_lag1(t):
    out = causality.granger_lag1(t.sector_news, "score", "close", key="sector")
    return out.select("sector", "n", snap("chi2").alias("chi2"), "is_significant")


@query("d32b_granger")
def granger(t):
    return causality.granger(t.sector_news, "score", "close", max_lag=5, key="sector", make_stationary=True)


def adf_sql(value):
    """t statistic of the lagged level with constant and one lagged difference, from centred moments."""
    return f"""SELECT sector, CAST(count(*) AS DOUBLE) AS n, var_pop(d) AS yy, var_pop(l) AS ll, var_pop(d1) AS dd, covar_pop(d, l) AS ly, covar_pop(d, d1) AS dy, covar_pop(l, d1) AS ld FROM (
      SELECT *, lag(d) OVER (PARTITION BY sector ORDER BY dt) AS d1 FROM (
        SELECT sector, dt, {value} - lag({value}) OVER w AS d, lag({value}) OVER w AS l FROM src WINDOW w AS (PARTITION BY sector ORDER BY dt))) WHERE d1 IS NOT NULL GROUP BY sector"""


T_STAT = """SELECT sector, b / sqrt(n * (yy - b * ly - g * dy) / (n - 3) / (n * (ll - ld * ld / dd))) AS t FROM
    (SELECT *, (ly * dd - dy * ld) / (ll * dd - ld * ld) AS b, (dy * ll - ly * ld) / (ll * dd - ld * ld) AS g FROM ({m}))"""


@query(
    "d33_stationarity",
    f"""WITH src0 AS (SELECT sector, dt, close FROM sector_news_v), a AS ({T_STAT.replace("{m}", adf_sql("close").replace("FROM src ", "FROM src0 "))}),
    src1 AS (SELECT * FROM (SELECT sector, dt, close - lag(close) OVER (PARTITION BY sector ORDER BY dt) AS close FROM src0) WHERE close IS NOT NULL),
    b AS ({T_STAT.replace("{m}", adf_sql("close").replace("FROM src ", "FROM src1 "))})
    SELECT a.sector, SNAP6(a.t) AS t_level, SNAP6(b.t) AS t_diff, CAST(CASE WHEN a.t < -2.86 THEN 0 WHEN b.t < -2.86 THEN 1 ELSE 2 END AS BIGINT) AS n_diff FROM a JOIN b ON a.sector = b.sector""",
)
def stationarity(t):
    out = causality.stationarity(t.sector_news, "close", key="sector")
    return out.select("sector", *s6("t_level", "t_diff"), "n_diff")
