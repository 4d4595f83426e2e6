"""Model training, scoring and evaluation (K)."""

from pyspark.sql import functions as F

from panelmill.functions.columns import apply_threshold, snap
from panelmill.operators import learners, models, news, panel, splits, stats, trees
from panelmill.plans import config
from panelmill.plans.q_stats import SAMPLE_FEATS
from panelmill.plans.registry import query
from panelmill.session import materialise

ENDO = ["ret_w0_mean", "ret_w1_mean", "ret_w0_std", "ret_w1_std", "cumret_w0", "cumret_w1", "vol_change_w0w1"]
EXO = ENDO + ["macro_usd_egp_change", "macro_cbe_lending_rate_level"]


def s6(*names):
    return [snap(n).alias(n) for n in names]


def split_samples(t):
    return splits.purged_split(t.samples)


def test_metrics_per_key(fits, df, shares=False):
    """Test metrics per ticker beside the number of trees its model uses."""
    scored = trees.score_per_key(df.filter("split = 'test'"), fits, ENDO, shares=shares)
    m = stats.binary_metrics(scored.withColumn("yhat", apply_threshold("p", F.lit(0.5))), "target", "yhat", "ticker")
    return m.join(fits.select("ticker", "n_trees"), "ticker").select("ticker", "n_trees", *s6("precision", "recall", "f1", "accuracy"))


@query("k01_fit_boosted")
def k01(t):
    df = split_samples(t)
    return test_metrics_per_key(materialise(trees.fit_boosted_per_key(df, ENDO, "target"), "k01"), df)


@query("k02_fit_forest")
def k02(t):
    df = split_samples(t)
    return test_metrics_per_key(materialise(trees.fit_forest_per_key(df, ENDO, "target"), "k02"), df, shares=True)


@query("k03_fit_hist_boosted")
def k03(t):
    df = split_samples(t)
    return test_metrics_per_key(materialise(trees.fit_hist_boosted_per_key(df, ENDO, "target"), "k03"), df)


@query("k04_fit_logistic_per_key")
def k04(t):
    df = materialise(split_samples(t).select("ticker", "dt", "split", "target", *ENDO), "k04")
    fits = learners.fit_logistic_per_key(df.filter("split = 'train'"), ENDO, "target", ["ticker"])
    scored = learners.score_logistic(df.filter("split = 'test'"), fits, ENDO, ["ticker"])
    m = stats.binary_metrics(scored.withColumn("yhat", apply_threshold("p", F.lit(0.5))), "target", "yhat", "ticker")
    return m.select("ticker", *s6("precision", "recall", "f1", "accuracy"))


@query(
    "k04b_logistic_converged",
    """SELECT ticker, count(*) AS n_train, TRUE AS converged FROM split_v WHERE split = 'train' GROUP BY ticker HAVING min(target) <> max(target)""",
)
def k04b(t):
    """At the stored coefficients no slope of the penalised loss is left: an independent check of the fits, as column arithmetic."""
    train = split_samples(t).filter("split = 'train'")
    fits = materialise(learners.fit_logistic_per_key(train, ENDO, "target", ["ticker"]), "k04b")
    return learners.logistic_slopes(train, fits, ENDO, "target", ["ticker"]).select("ticker", "n_train", (F.col("slope") < 1e-6).alias("converged"))


@query(
    "k05_class_weights",
    """SELECT ticker, dt, target, SNAP6(CAST(count(*) OVER (PARTITION BY ticker) AS DOUBLE) / (2 * count(*) OVER (PARTITION BY ticker, target))) AS weight FROM split_v WHERE split = 'train'""",
)
def k05(t):
    return splits.class_weights(split_samples(t).filter("split = 'train'"), "target").select("ticker", "dt", "target", snap("weight").alias("weight"))


@query(
    "k06_standardise",
    "WITH st AS (SELECT ticker, " + ", ".join(f"avg({c}) AS m_{c}, SNAP9(stddev_pop({c})) AS s_{c}" for c in SAMPLE_FEATS[:3])
    + " FROM split_v WHERE split = 'train' GROUP BY ticker) SELECT s.ticker, s.dt, "
    + ", ".join(f"SNAP6(SNAP9((s.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)) AS {c}" for c in SAMPLE_FEATS[:3])
    + " FROM split_v s JOIN st ON st.ticker = s.ticker",
)
def k06(t):
    out = splits.standardise(split_samples(t), SAMPLE_FEATS[:3], F.col("split") == "train", population=True)
    return out.select("ticker", "dt", *s6(*SAMPLE_FEATS[:3]))


PRICES = ["open", "high", "low", "close", "volume"]


@query("k07_prune_collinear_importance")
def k07(t):
    rows = t.bars.withColumn("target", panel.buffered_target(panel.next_return("close", panel.by_key())))
    dropped = learners.prune_by_importance(rows, PRICES, "target")
    return t.spark.createDataFrame([(i, c) for i, c in enumerate(dropped)], "step long, dropped string")


@query("k08_prune_collinear_target")
def k08(t):
    rows = t.bars.withColumn("target", panel.buffered_target(panel.next_return("close", panel.by_key())))
    dropped = learners.prune_by_target(rows, PRICES, "target")
    return t.spark.createDataFrame([(i, c) for i, c in enumerate(dropped)], "step long, dropped string")


@query(
    "k09_score_and_decide",
    """WITH th AS (SELECT ticker, SNAP9(quantile_cont(p_exo, 0.4)) AS threshold FROM score_v WHERE split = 'val' GROUP BY ticker)
    SELECT s.ticker, s.dt, SNAP6(threshold) AS threshold, CAST(CASE WHEN p_exo >= threshold THEN 1 ELSE 0 END AS BIGINT) AS decision FROM score_v s JOIN th ON th.ticker = s.ticker WHERE split = 'test'""",
)
def k09(t):
    return models.score_and_decide(t.scores, "p_exo").select("ticker", "dt", snap("threshold").alias("threshold"), "decision")


REPORT = ["train_pos_ratio", "endo_f1", "endo_precision", "endo_recall", "endo_threshold", "endo_auc", "exo_f1", "exo_precision", "exo_recall", "exo_threshold", "exo_auc", "f1_lift", "auc_lift", "dm_stat"]


@query("k10_compare_feature_sets", "SELECT ticker, sector, samples, test, exo_better, significant, " + ", ".join(f"SNAP6({c}) AS {c}" for c in REPORT) + " FROM report_v")
def k10(t):
    r = models.compare_feature_sets(t.scores)
    return r.select("ticker", "sector", "samples", "test", "exo_better", "significant", *s6(*REPORT))


@query("k10b_run_experiment")
def k10b(t):
    """The whole experiment: two fitted ensembles per ticker at the published settings."""
    names = {"usd_sell_rate": "usd_egp", "gold_24k": "gold_local", "cbe_lending_rate": "cbe_rate", "headline_inflation": "inflation"}
    macro = panel.merge_series(t.macro.select("dt", *[F.col(c).alias(n) for c, n in names.items()]), t.globals)
    series = panel.fill_columns(macro, [c for c in macro.columns if c != "dt"], key=None)
    r = models.run_experiment(t.bars, series)
    return models.rounded_report(r)


@query("k11_walk_forward_tournament")
def k11(t):
    report = learners.walk_forward_tournament(t.samples, "target", {"endo": ENDO, "exo": EXO}, learners.WINDOWS)
    return report.select("ticker", "window", "n", "n_folds", *s6("endo_f1", "exo_f1", "endo_precision", "exo_precision", "endo_recall", "exo_recall", "dm", "p_value", "lift_pct"), "significant")


@query("k11b_tournament_winners")
def k11b(t):
    report = learners.walk_forward_tournament(t.samples, "target", {"endo": ENDO, "exo": EXO}, learners.WINDOWS)
    return learners.tournament_winners(report).select("ticker", "window", snap("lift_pct").alias("best_lift_pct"), "significant")


@query(
    "k12_sharpe_training",
    """WITH g AS (SELECT s.ticker, k.threshold, fwd_ret / 100 AS x FROM score_v s JOIN sweep_v k ON k.ticker = s.ticker WHERE split = 'test'),
    h AS (SELECT s.ticker, k.threshold, CASE WHEN p_endo >= k.threshold THEN fwd_ret / 100 END AS x FROM score_v s JOIN sweep_v k ON k.ticker = s.ticker WHERE split = 'test'),
    a AS (SELECT ticker, threshold, count(x) AS n, CASE WHEN count(x) >= 10 AND SNAP9(stddev_pop(x)) > 0 THEN avg(x) / stddev_pop(x) * sqrt(252) ELSE -999 END AS sharpe,
      CASE WHEN count(x) = 0 THEN 0 WHEN min(1 + x) <= 0 THEN -1 ELSE exp(sum(CASE WHEN 1 + x > 0 THEN ln(1 + x) END) * 252 / count(x)) - 1 END AS cagr,
      coalesce(avg(CASE WHEN x > 0 THEN 1.0::DOUBLE WHEN x IS NOT NULL THEN 0.0::DOUBLE END), 0) AS win_rate FROM h GROUP BY ticker, threshold)
    SELECT ticker, SNAP6(threshold) AS threshold, SNAP6(CASE WHEN n >= 10 THEN sharpe ELSE 0 END) AS sharpe, SNAP6(CASE WHEN n >= 10 THEN cagr ELSE 0 END / 1000000) AS cagr_millions,
    SNAP6(CASE WHEN n >= 10 THEN win_rate ELSE 0 END) AS win_rate, CASE WHEN n >= 10 THEN n ELSE 0 END AS n_trades FROM a""",
)
def k12(t):
    # the thresholds come from the unscaled returns; the scaled ones keep the compound growth finite
    best = stats.sharpe_threshold_sweep(t.scores.filter("split = 'val'"), "p_endo", "fwd_ret").select("ticker", "threshold")
    test = t.scores.filter("split = 'test'").withColumn("x", F.col("fwd_ret") / 100)
    out = learners.trade_summary(test, best, "p_endo", "x", ["ticker"])
    return out.select("ticker", *s6("threshold", "sharpe", "win_rate"), snap(F.col("cagr") / 1000000).alias("cagr_millions"), "n_trades")


@query("k12b_sharpe_training_fitted")
def k12b(t):
    df = materialise(split_samples(t).select("ticker", "dt", "split", "target", *ENDO), "k12b")
    fits = learners.fit_logistic_per_key(df.filter("split = 'train'"), ENDO, "target", ["ticker"])
    fwd = t.bars.select("ticker", "dt", (panel.next_return("close", panel.by_key(), 5) / 100).alias("r"))
    scored = learners.score_logistic(df, fits, ENDO, ["ticker"]).join(fwd, ["ticker", "dt"])
    out = learners.sharpe_training(scored.withColumn("p", snap("p", 9)), "p", "r")
    return out.select("ticker", *s6("threshold", "sharpe", "win_rate"), "n_trades")


def strategy_sql(name, p, rule):
    table = (
        f"(SELECT ticker, SNAP9(quantile_cont({p}, 0.4)) AS threshold FROM score_v WHERE split = 'val' GROUP BY ticker)"
        if rule == "percentile"
        else "(SELECT ticker, threshold FROM sweep_v)"
    )
    return f"""SELECT s.ticker, '{name}_{rule}' AS strategy, SNAP6(k.threshold) AS threshold, count(*) FILTER (WHERE {p} >= k.threshold) AS trade_count,
    SNAP6(coalesce(avg(y) FILTER (WHERE {p} >= k.threshold), 0)) AS "precision", SNAP6(coalesce(avg(fwd_ret) FILTER (WHERE {p} >= k.threshold), 0)) AS mean_return
    FROM score_v s JOIN {table} k ON k.ticker = s.ticker WHERE split = 'test' GROUP BY s.ticker, k.threshold"""


@query("k13_strategy_grid", " UNION ALL ".join([strategy_sql("stock", "p_endo", "percentile"), strategy_sql("stock", "p_endo", "sharpe"), strategy_sql("hybrid", "p_exo", "percentile"), strategy_sql("hybrid", "p_exo", "sharpe").replace("sweep_v", "sweep_exo_v")]))
def k13(t):
    out = learners.strategy_grid(t.scores, {"stock": "p_endo", "hybrid": "p_exo"}, "fwd_ret")
    return out.select("ticker", "strategy", "trade_count", *s6("threshold", "precision", "mean_return"))


@query("k14_lexicon_sentiment", "SELECT seq, lex_score, lex_label FROM lex_v")
def k14(t):
    return news.lexicon_sentiment(t.articles, config.LEXICON).select("seq", "lex_score", "lex_label")


@query(
    "k15_market_digest",
    """WITH r AS (SELECT t.ticker, a.dt, a.seq, coalesce(a.sentiment, 'neutral') AS sentiment, left(a.text, 500) AS excerpt,
      row_number() OVER (PARTITION BY t.ticker ORDER BY a.dt DESC, a.seq DESC) AS rn FROM articles_v a JOIN tags_v t ON t.seq = a.seq)
    SELECT ticker, count(*) AS n_articles, SNAP6(100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'positive') / count(*)) AS positive_pct,
    SNAP6(100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'negative') / count(*)) AS negative_pct, SNAP6(100.0::DOUBLE * count(*) FILTER (WHERE sentiment = 'neutral') / count(*)) AS neutral_pct,
    string_agg(concat('- ', excerpt), chr(10) || chr(10) ORDER BY rn) AS headlines FROM r WHERE rn <= 50 GROUP BY ticker""",
)
def k15(t):
    return news.market_digest(t.articles, config.ALIASES)


@query("k16_feature_importance")
def k16(t):
    fits = trees.fit_forest_per_key(split_samples(t), EXO, "target")
    return trees.importance_per_key(fits, EXO).withColumn("importance", snap("importance"))
