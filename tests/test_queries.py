"""Registered queries against their SQL twins on the smallest tables.

All queries are compared at sf 0.01 with `python -m tests.oracle`; here one or two of every section keep the run short.
PANELMILL_ALL=1 compares every one.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
CHOSEN = """a01_read_bars a09_extract_links a12_extract_article_text b14_eligible_keys c07_asof_macro c12_peer_mentions d03_stock_day_sentiment
d09_correlation_matrix d12_class_balance d26_roc_auc d32_granger_lag1 d37_sharpe_threshold_sweep e04_lookback_matrix e09_rsi e22_three_week_samples
e28_walk_forward_folds f04_first_n_per_group g03_missing_trading_days g07_dedupe_url h11_parse_model_reply i03_stream_daily_sentiment i05_late_catch_up
j03_grouped_map k10_compare_feature_sets k13_strategy_grid k15_market_digest l01_prepare_training l05_weekly_features_v2 l08_integrity_audit""".split()
NAMES = sorted(entry.queries()) if os.environ.get("PANELMILL_ALL") else CHOSEN


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, duck, name):
    status, _, note = compare(spark, duck, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert status in ("ok", "rows"), note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["e22_three_week_samples", "k10_compare_feature_sets", "l04_daily_features_v1", "d37_sharpe_threshold_sweep"])
def test_one_exchange_per_ticker(spark, name):
    """Chains of window operators shuffle the bars once by ticker, after the daily aggregation."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_sentiment_meets_the_bars_without_a_shuffle(spark):
    """The news of a day is one broadcast row; only lines, bars' days and articles are dealt out."""
    plan = entry.queries()["c04_join_sentiment"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and not any("Exchange hashpartitioning" in line and "entity" in line for line in plan.splitlines())


def test_daily_features_pass_over_the_rows_twice(spark):
    """One window pass for the lags, one for the frames over them; no frame computes the same deviation twice."""
    plan = entry.queries()["l04_daily_features_v1"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Window [")]
    assert len(windows) == 2
    assert sum(line.count("stddev_samp(return_1d") for line in windows) == 3
