"""Statistics, learners and causality against numpy references."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions.columns import squared_loss, t_critical_95
from panelmill.operators import causality, learners, models, splits, stats

DAY0 = dt.date(2024, 1, 1)


def frame(spark, schema, **cols):
    names = [c.split()[0] for c in schema.split(", ")]
    n = len(next(iter(cols.values())))
    rows = list(zip(*[[float(v) if isinstance(v, (np.floating, float)) else v for v in cols[c]] if c in cols else [None] * n for c in names]))
    return spark.createDataFrame(rows, schema)


def days(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def test_causal_pair_is_found_and_random_is_not(spark):
    rnd = np.random.default_rng(42)
    news = rnd.normal(0, 1, 120)
    price = 100 + 2 * np.concatenate([[0.0], news[:-1]]) + rnd.normal(0, 0.1, 120)
    other = rnd.normal(100, 10, 120)
    rows = [("causal", d, float(x), float(y)) for d, x, y in zip(days(120), news, price)]
    rows += [("random", d, float(x), float(y)) for d, x, y in zip(days(120), news, other)]
    df = spark.createDataFrame(rows, "ticker string, dt date, score double, close double")
    got = {r["ticker"]: r for r in causality.granger(df, "score", "close", 5, make_stationary=True).collect()}
    assert got["causal"]["best_lag"] == 1 and got["causal"]["is_significant"]
    assert not got["random"]["is_significant"]
    # the closed form for one lag is the same test
    one = {r["ticker"]: r for r in causality.granger_lag1(df, "score", "close").collect()}
    x, a, b = price[1:], price[:-1], news[:-1]
    ssr = lambda cols: np.linalg.lstsq(np.column_stack([np.ones(119), *cols]), x, rcond=None)[1][0]
    chi2 = 119 * (ssr([a]) - ssr([a, b])) / ssr([a, b])
    assert one["causal"]["chi2"] == pytest.approx(chi2, rel=1e-6)


def test_too_short_series_has_no_lag(spark):
    df = spark.createDataFrame([("A", d, float(i), float(i * i % 7)) for i, d in enumerate(days(10))], "ticker string, dt date, score double, close double")
    r = causality.granger(df, "score", "close", 5).first()
    assert r["best_lag"] == -1 and not r["is_significant"]
    assert causality.granger(df, "score", "close", 5, shrink_lag=True).first()["sample_size"] == 10


def test_unit_root_and_difference_order(spark):
    rnd = np.random.default_rng(3)
    noise, walk = rnd.normal(0, 1, 300), np.cumsum(rnd.normal(0, 1, 300))
    rows = [("noise", d, float(v)) for d, v in zip(days(300), noise)] + [("walk", d, float(v)) for d, v in zip(days(300), walk)]
    got = {r["ticker"]: r["n_diff"] for r in causality.stationarity(spark.createDataFrame(rows, "ticker string, dt date, close double"), "close").collect()}
    assert got == {"noise": 0, "walk": 1}


def test_chi_square_tail():
    for x, k, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.0705, 5, 0.05), (9.487729, 4, 0.05), (7.814728, 3, 0.05)):
        assert causality.chi2_tail(x, k) == pytest.approx(p, abs=1e-6)


def test_student_tail_and_critical_value(spark):
    for t, v in ((2.228139, 10), (2.085963, 20), (1.983972, 100), (2.776445, 4), (2.570582, 5)):
        assert stats._student_tail(t, v) == pytest.approx(0.05, abs=1e-6)
    got = spark.range(1).select(t_critical_95(F.lit(20)).alias("t")).first()["t"]
    assert got == pytest.approx(2.085963, abs=1e-3)


def test_diebold_mariano(spark):
    rnd = np.random.default_rng(1)
    a, b = rnd.exponential(0.3, 100), rnd.exponential(0.25, 100)
    df = spark.createDataFrame([("A", d, float(x), float(y)) for d, x, y in zip(days(100), a, b)], "ticker string, dt date, a double, b double")
    d = a - b
    one = stats.diebold_mariano(df, F.col("a"), F.col("b")).first()["dm"]
    assert one == pytest.approx(d.mean() / math.sqrt(d.var(ddof=1) / 100))
    v = d.var(ddof=1) + sum(2 * (1 - k / 3) * np.cov(d[:-k], d[k:])[0, 1] for k in (1, 2))
    assert stats.diebold_mariano(df, F.col("a"), F.col("b"), h=3).first()["dm"] == pytest.approx(d.mean() / math.sqrt(v / 100))
    assert stats.diebold_mariano(df.limit(9), F.col("a"), F.col("b")).first()["dm"] is None
    assert stats.diebold_mariano(df, F.col("a"), F.col("a")).first()["dm"] is None


def test_auc_with_ties_and_one_class(spark):
    y, p = [1, 0, 1, 0, 1, 0, 0], [0.9, 0.9, 0.8, 0.3, 0.3, 0.3, 0.1]
    rows = [("A", a, b) for a, b in zip(y, p)] + [("B", 1, 0.5)]
    got = {r["k"]: r["auc"] for r in stats.roc_auc(spark.createDataFrame(rows, "k string, y int, p double"), "y", "p", "k").collect()}
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a, u in zip(p, y) if u for b, v in zip(p, y) if not v]
    assert got["A"] == pytest.approx(np.mean(wins)) and got["B"] is None


def test_empty_denominators_give_zero(spark):
    df = spark.createDataFrame([("A", 0, 0)], "k string, y int, yhat int")
    r = stats.binary_metrics(df, "y", "yhat", "k").first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_sharpe_cagr_win_rate(spark):
    rnd = np.random.default_rng(8)
    r = rnd.normal(0.001, 0.01, 50)
    df = spark.createDataFrame([("A", float(x)) for x in r] + [("few", 0.1)] * 3 + [("lost", -1.0)] * 12, "k string, r double")
    sharpe = {x["k"]: x["sharpe"] for x in stats.annualized_sharpe(df, "r", "k").collect()}
    assert sharpe["A"] == pytest.approx(r.mean() / r.std() * math.sqrt(252)) and sharpe["few"] == -999.0 and sharpe["lost"] == -999.0
    growth = {x["k"]: x["cagr"] for x in stats.cagr(df, "r", "k").collect()}
    assert growth["A"] == pytest.approx(np.prod(1 + r) ** (252 / 50) - 1) and growth["lost"] == -1.0
    assert {x["k"]: x["win_rate"] for x in stats.win_rate(df, "r", "k").collect()}["A"] == pytest.approx((r > 0).mean())


def test_threshold_sweep_equals_the_loop(spark):
    rnd = np.random.default_rng(12)
    rows, want = [], {}
    for key in ("a", "b", "c", "d"):
        p = np.round(rnd.uniform(0.2, 1.0, 60), 2 if key == "a" else 6)
        r = rnd.normal(0.002 if key != "d" else -0.05, 0.02, 60)
        rows += [(key, float(x), float(y)) for x, y in zip(p, r)]
        best = None
        for t in range(40, 91):
            take = r[p >= t / 100 - 1e-12]
            if len(take) >= 10 and take.std() > 0 and (take > 0).mean() >= 0.5:
                s = round(take.mean() / take.std() * math.sqrt(252), 6)
                if best is None or s > best[1]:
                    best = (t / 100, s)
        want[key] = best or (0.5, None)
    got = {x["ticker"]: (x["threshold"], x["best_sharpe"]) for x in stats.sharpe_threshold_sweep(spark.createDataFrame(rows, "ticker string, p double, r double"), "p", "r").collect()}
    for key, (t, s) in want.items():
        assert got[key][0] == pytest.approx(t)
        assert got[key][1] == (pytest.approx(s, abs=1e-5) if s is not None else None)


def test_logistic_fit_is_the_optimum():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(200, 3))
    y = (x @ [1.0, -2.0, 0.5] + rnd.logistic(size=200) > 0.3).astype(float)
    w, b = learners.logistic_fit(x, y, 0.1)
    weight = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    miss = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
    assert np.abs(0.1 * x.T @ miss + w).max() < 1e-6 and abs(miss.sum()) < 1e-6


def test_logistic_scores_match_the_coefficients(spark):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(80, 2))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([("A", float(a), float(b), int(c)) for (a, b), c in zip(x, y)] + [("B", 1.0, 2.0, 1)], "ticker string, f1 double, f2 double, y int")
    fits = learners.fit_logistic_per_key(df, ["f1", "f2"], "y", ["ticker"])
    assert [r["ticker"] for r in fits.collect()] == ["A"]
    f = fits.first()
    z = (x - np.array(f["mu"])) / np.array(f["sigma"]) @ np.array(f["coef"]) + f["intercept"]
    got = [r["p"] for r in learners.score_logistic(df, fits, ["f1", "f2"], ["ticker"]).orderBy("f1").collect()]
    assert got == pytest.approx(sorted_by(x[:, 0], 1 / (1 + np.exp(-z))))


def sorted_by(key, values):
    return list(np.array(values)[np.argsort(key)])


def test_greedy_pruning():
    pairs = [("a", "b", 0.99), ("b", "c", 0.95), ("c", "d", 0.9)]
    assert learners.prune_collinear(pairs, {"a": 1, "b": 2, "c": 3, "d": 0}) == ["a", "b", "d"]
    assert learners.prune_collinear([("a", "b", 0.9)], {"a": 1, "b": 1}) == ["a"]
    assert learners.prune_collinear([("a", "b", 0.9)], {"a": 1, "b": 1}, ties="second") == ["b"]


def test_comparison_needs_a_better_model(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for i, d in enumerate(days(300)):
        y = int(rnd.uniform() > 0.5)
        split = "train" if i < 150 else "val" if i < 180 else "test"
        good, bad = 0.5 + (y - 0.5) * 0.6 + rnd.normal(0, 0.05), rnd.uniform(0.3, 0.7)
        rows += [("good", "X", d, split, y, float(bad), float(good)), ("same", "X", d, split, y, float(bad), float(bad))]
    df = spark.createDataFrame(rows, "ticker string, sector string, dt date, split string, y int, p_endo double, p_exo double")
    got = {r["ticker"]: r for r in models.compare_feature_sets(df).collect()}
    assert got["good"]["significant"] and got["good"]["exo_auc"] > 0.99 and got["good"]["dm_stat"] > 0
    assert not got["same"]["significant"] and got["same"]["dm_stat"] is None and got["same"]["f1_lift"] == 0.0


def test_tournament_averages_folds(spark):
    """Two folds of unlike size, by hand: fold means, not pooled counts; p by the pooled statistic; 30 rows at least."""
    # (fold, label, p_a, p_b, rows). Fold 0: a has tp 4, fp 4, fn 2; b has tp 6, fp 4. Fold 1: a has tp 10, fn 10; b has tp 20.
    cells = [
        (0, 1, 0.75, 0.875, 4), (0, 1, 0.25, 0.625, 2), (0, 0, 0.75, 0.625, 4), (0, 0, 0.25, 0.25, 2),
        (1, 1, 0.75, 0.75, 10), (1, 1, 0.375, 0.625, 10),
    ]
    rows = [("x", "w", f, y, a, b) for f, y, a, b, n in cells for _ in range(n)]
    rows += [("x", "even", 0, 1, 0.75, 0.75)] * 40 + [("x", "short", 0, 1, 0.75, 0.75)] * 29
    df = spark.createDataFrame(rows, "ticker string, window string, fold int, y int, p_a double, p_b double")
    out = {r["window"]: r for r in learners.tournament_report(df, "y", "a", "b", "ticker").collect()}
    assert set(out) == {"w", "even"}
    r = out["w"]
    assert (r.n, r.n_folds) == (32, 2)
    f1 = lambda tp, fp, fn: 2 * tp / (2 * tp + fp + fn)
    assert r.a_f1 == pytest.approx((f1(4, 4, 2) + f1(10, 0, 10)) / 2) and r.b_f1 == pytest.approx((f1(6, 4, 0) + f1(20, 0, 0)) / 2)
    assert r.a_precision == pytest.approx((4 / 8 + 1) / 2) and r.b_precision == pytest.approx((6 / 10 + 1) / 2)
    assert r.a_recall == pytest.approx((4 / 6 + 10 / 20) / 2) and r.b_recall == pytest.approx(1.0)
    d = np.array([(y - a) ** 2 - (y - b) ** 2 for _, w, _, y, a, b in rows if w == "w"])
    assert r.dm == pytest.approx(d.mean() / math.sqrt(d.var(ddof=1) / len(d)))
    assert r.p_value == pytest.approx(stats._student_tail(r.dm, 31)) and r.significant
    assert r.lift_pct == pytest.approx(100 * (r.b_f1 - r.a_f1) / r.a_f1)
    assert out["even"].dm is None and out["even"].p_value is None and not out["even"].significant


def plain_newton(x, y, c):
    """One logistic fit, one step after the other."""
    xb, n = np.hstack([x, np.ones((len(y), 1))]), len(y)
    w = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum())))
    penalty, beta = np.append(np.ones(x.shape[1]), 0.0), np.zeros(x.shape[1] + 1)
    for _ in range(200):
        p = 1 / (1 + np.exp(-xb @ beta))
        h = c * (xb.T * (w * p * (1 - p))) @ xb + np.diag(penalty)
        beta = beta - 0.5 * np.linalg.solve(h, c * xb.T @ (w * (p - y)) + penalty * beta)
    return beta


def test_fits_side_by_side_are_the_single_fits(monkeypatch):
    """Of any length, with separable classes and equal columns among them, and in matrices of any size."""
    rnd, parts = np.random.default_rng(8), []
    for n in (2, 5, 40, 41, 43, 44, 300, 41):
        x = rnd.normal(size=(n, 3))
        y = (x[:, 0] > np.median(x[:, 0])).astype(float) if n in (2, 43) else (rnd.uniform(size=n) > 0.3).astype(float)
        y[:2] = 0, 1
        parts.append((np.column_stack([x, x[:, 0]]), y))
    for cells in (learners.CELLS, 1):
        monkeypatch.setattr(learners, "CELLS", cells)
        for (x, y), (w, b) in zip(parts, learners.logistic_fits(parts, 0.1), strict=True):
            assert np.append(w, b) == pytest.approx(plain_newton(x, y, 0.1), abs=1e-7)
    assert learners.logistic_fits([], 0.1) == []


def test_tournament_fits_both_sets_in_one_pass(spark):
    """The scores are those of the coefficients per key and set; rows of null keys and of one class go; the folds are not shuffled."""
    rnd, rows = np.random.default_rng(9), []
    for key, one in (("A", False), ("B", False), ("C", True), (None, False)):
        for i, d in enumerate(days(60)):
            x = rnd.normal(size=2)
            rows.append((key, d, None if i % 7 == 0 else float(x[0]), float(x[1]), 1 if one else int(x.sum() + rnd.normal() > 0)))
    df = spark.createDataFrame(rows, "ticker string, dt date, f1 double, f2 double, y int")
    sets, keys = {"a": ["f2"], "b": ["f2", "f1"]}, ["ticker", "window", "fold"]
    folds = splits.walk_forward_folds(df, {"w": 20, "v": 30}, 5)
    got = learners.fit_and_score_folds(folds, "y", sets, keys)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1
    want, train = folds.filter("role = 'test'"), folds.filter("role = 'train'")
    for name, features in sets.items():
        want = learners.score_logistic(want, learners.fit_logistic_per_key(train, features, "y", keys), features, keys, f"p_{name}")
    order = lambda t: sorted(tuple(r) for r in t.select(*keys, "y", F.round("p_a", 9), F.round("p_b", 9)).collect())
    assert {r.ticker for r in got.collect()} == {"A", "B"} and order(got) == order(want)


def test_report_sorts_test_rows_only(spark):
    """Keys without test rows or with several labels keep their counts; of the others only test rows reach the ranks."""
    rnd, rows = np.random.default_rng(3), []
    for key, labels, tests in (("a", ["X"], True), ("b", ["X", "Y", None], True), ("c", [None], True), ("d", ["X"], False)):
        for i, d in enumerate(days(90)):
            split = ("train" if i < 60 else "val") if i < 70 or not tests else "test"
            rows.append((key, labels[i % len(labels)], d, split, int(rnd.uniform() > 0.5), *map(float, rnd.uniform(size=2))))
    df = spark.createDataFrame(rows, "ticker string, sector string, dt date, split string, y int, p_endo double, p_exo double")
    report = models.compare_feature_sets(df)
    got = {(r.ticker, r.sector): r for r in report.collect()}
    for (key, label), r in got.items():
        own = [x for x in rows if x[:2] == (key, label)]
        train = [x[4] for x in own if x[3] == "train"]
        assert (r.samples, r.test) == (len(own), sum(x[3] == "test" for x in own)) and r.train_pos_ratio == pytest.approx(np.mean(train))
    assert set(got) == {("a", "X"), ("b", "X"), ("b", "Y"), ("b", None), ("c", None), ("d", "X")}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("rank(") :].splitlines()  # the plan is printed from the top
    assert any("Filter" in line and "= test" in line for line in below)


def test_correlations_of_all_pairs_in_one_pass(spark):
    """As `corr` of each pair, nulls pair by pair; constant columns have none; no aggregate per pair."""
    rnd = np.random.default_rng(5)
    rows = []
    for i in range(400):
        a = float(rnd.normal()) + 1e6
        b = None if i % 3 else a * 2 + float(rnd.normal())
        rows.append((a, b, 0.1, None if i % 3 else 7.7, int(rnd.integers(5)), 5.0 + (0.0 if i % 3 == 0 else a)))
    names = ["a", "b", "same", "same_b", "n", "flat_b"]
    df = spark.createDataFrame(rows, "a double, b double, same double, same_b double, n int, flat_b double").repartition(5)
    out = stats.correlation_pairs(df, names)
    got = {(r.feature_a, r.feature_b): r["corr"] for r in out.collect()}
    assert len(got) == 15 and out._jdf.queryExecution().analyzed().toString().count("corr(") == 0
    for pair, value in got.items():
        x = np.array([(r[names.index(pair[0])], r[names.index(pair[1])]) for r in rows if None not in (r[names.index(pair[0])], r[names.index(pair[1])])], float)
        if min(np.ptp(x, axis=0)) == 0:
            assert value is None, pair
        else:
            assert value == pytest.approx(np.corrcoef(x.T)[0, 1], abs=1e-9), pair
    for few in (df.limit(0), df.limit(1)):
        assert [r["corr"] for r in stats.correlation_pairs(few, names[:3]).collect()] == [None] * 3
