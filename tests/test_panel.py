"""Window features, splits and joins on tiny frames with known answers."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.functions.columns import ratio, snap, zero_if_null
from panelmill.operators import features, panel, splits
from panelmill.operators.panel import by_key

DAY0 = dt.date(2024, 1, 1)


def bars(spark, closes, ticker="A", volumes=None, sector="X"):
    rows = [
        (ticker, DAY0 + dt.timedelta(days=i), "I", sector, c, c if c is None else c + 1, c if c is None else c - 1, c, (volumes or [10] * len(closes))[i])
        for i, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "ticker string, dt date, isin string, sector string, open double, high double, low double, close double, volume long")


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "dt").collect()]


def test_percent_change_pads_nulls_and_guards_zero(spark):
    df = bars(spark, [2.0, None, 3.0, 0.0, 5.0])
    out = panel.pct_change_padded(df, "close", 1, "r")
    assert column(out, "r") == [None, 0.0, 0.5, -1.0, None]


def test_first_log_return_is_zero(spark):
    got = column(bars(spark, [1.0, math.e]).withColumn("r", panel.log_return("close", by_key())), "r")
    assert got == [0.0, pytest.approx(1.0)]


def test_deviation_forms(spark):
    df = bars(spark, [1.0, 2.0, 4.0])
    sample = column(df.withColumn("s", panel.volatility("close", 3, by_key(), 3)), "s")[-1]
    assert sample == pytest.approx(np.std([1, 2, 4], ddof=1))
    z = column(df.withColumn("z", splits.zscore_expr("close", F.lit(True), population=True)), "z")
    assert z == pytest.approx(list((np.array([1, 2, 4]) - 7 / 3) / np.std([1, 2, 4])), abs=1e-6)


def test_zero_sigma_is_one_and_nulls_become_zero(spark):
    z = column(bars(spark, [5.0, 5.0, None]).withColumn("z", splits.zscore_expr("close", F.lit(True))), "z")
    assert z == [0.0, 0.0, 0.0]


def test_null_comparisons_give_zero(spark):
    df = bars(spark, [1.0, 1.1])
    assert column(df.withColumn("t", panel.buffered_target(panel.next_return("close", by_key()))), "t") == [1, 0]
    assert column(df.withColumn("r", F.lit(None).cast("double")).withColumn("f", panel.extreme_flag("r", by_key())), "f") == [0, 0]


def test_ratio_guards(spark):
    one = spark.range(1).select(ratio(F.lit(1.0), F.lit(0.0)).alias("a"), zero_if_null(ratio(F.lit(1.0), F.lit(0.0))).alias("b")).first()
    assert one["a"] is None and one["b"] == 0.0


def test_rsi_counts_the_first_delta(spark):
    closes = [float(x) for x in (10, 11, 12, 11, 13, 14, 13, 15, 16, 17, 16, 18, 19, 20, 19)]
    got = column(panel.with_rsi(bars(spark, closes), "close", 14, "rsi"), "rsi")
    assert got[:13] == [None] * 13
    delta = np.append(0.0, np.diff(closes))
    for row in (13, 14):
        part = delta[row - 13 : row + 1]
        gain, loss = part.clip(min=0).mean(), (-part).clip(min=0).mean()
        assert got[row] == pytest.approx(100 - 100 / (1 + gain / loss), abs=1e-5)
    flat = column(panel.with_rsi(bars(spark, [1.0] * 15), "close", 14, "rsi"), "rsi")
    rising = column(panel.with_rsi(bars(spark, [float(i) for i in range(1, 16)]), "close", 14, "rsi"), "rsi")
    assert flat[-1] is None and rising[-1] == 100.0


def test_forward_fill_is_per_key_and_never_looks_ahead(spark):
    df = bars(spark, [None, 1.0, None], "A").union(bars(spark, [None, 2.0], "B"))
    assert column(panel.fill_columns(df, ["close"]), "close") == [None, 1.0, 1.0, None, 2.0]
    assert column(panel.fill_columns(df, ["close"], backfill=True), "close") == [1.0, 1.0, 1.0, 2.0, 2.0]


def plain_samples(closes, w=5, step=1, m=0.001):
    """The loop form of the window samples: (last index of week 1, ratio, target)."""
    out = []
    for i in range(0, len(closes) - 3 * w + 1, step):
        past, future = closes[i : i + 2 * w], closes[i + 2 * w : i + 3 * w]
        r = (sum(future) / w) / (sum(past) / (2 * w))
        if not 1 - m <= r <= 1 + m:
            out.append((i + 2 * w - 1, r, int(r > 1 + m)))
    return out


@pytest.mark.parametrize("step", [1, 3])
def test_window_samples_equal_the_loop(spark, step):
    rnd = np.random.default_rng(5)
    closes = [float(x) for x in np.cumprod(1 + rnd.normal(0, 0.01, 60)) * 100]
    got = panel.window_samples(bars(spark, closes), step=step).orderBy("dt").collect()
    want = plain_samples(closes, step=step)
    assert [(r["dt"] - DAY0).days for r in got] == [x[0] for x in want]
    assert [r["ratio"] for r in got] == pytest.approx([x[1] for x in want], abs=1e-8)
    assert [r["target"] for r in got] == [x[2] for x in want]
    first, at = got[0], want[0][0]
    logs = [0.0] + [math.log(b / a) for a, b in zip(closes, closes[1:])]
    assert first["ret_w0_d0"] == pytest.approx(logs[at - 9]) and first["ret_w1_d4"] == pytest.approx(logs[at])
    assert first["ret_w0_std"] == pytest.approx(np.std(logs[at - 9 : at - 4], ddof=1))
    assert first["cumret_w1"] == pytest.approx(closes[at] / closes[at - 4] - 1)


def test_no_feature_sees_the_future(spark):
    closes = [float(x) for x in range(50, 90)]
    changed = closes[:-1] + [500.0]
    a = features.daily_features_v1(bars(spark, closes)).filter(F.col("dt") < DAY0 + dt.timedelta(days=39))
    b = features.daily_features_v1(bars(spark, changed)).filter(F.col("dt") < DAY0 + dt.timedelta(days=39))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("n", [12, 16, 100, 333])
def test_splits_are_ordered_and_gapped(spark, n):
    df = bars(spark, [1.0] * n).select("ticker", "dt")
    rows = splits.purged_split(df).orderBy("dt").collect()
    train, val, gap = int(n * 0.72), int(n * 0.08), 5
    if train + gap + val + gap >= n:  # validation takes the place of the first gap, its end stays
        want = ["train"] * train + ["val"] * (gap + val)
    else:
        want = ["train"] * train + [None] * gap + ["val"] * val + [None] * gap
    want = (want + ["test"] * (n - len(want)))[:n]
    assert [r["split"] for r in rows] == want


@pytest.mark.parametrize("n,window,test", [(200, 60, 20), (84, 60, 20), (83, 60, 20), (300, 126, 63)])
def test_folds_equal_the_generator(spark, n, window, test):
    got = splits.walk_forward_folds(bars(spark, [1.0] * n).select("ticker", "dt"), {"w": window}, test).collect()
    want, start, fold = set(), window + 4, 0
    while start + test <= n:
        lo = max(0, start - 4 - window)
        want |= {(fold, "train", i) for i in range(lo, start - 4)} | {(fold, "test", i) for i in range(start, start + test)}
        start, fold = start + test, fold + 1
    assert {(r["fold"], r["role"], r["row_no"] - 1) for r in got} == want and len(got) == len(want)


def test_broadcast_bound_is_enforced(spark):
    b = bars(spark, [1.0, 2.0])
    twice = spark.createDataFrame([(DAY0, 1.0), (DAY0, 2.0)], "dt date, v double")
    far = spark.createDataFrame([(dt.date(2500, 1, 1), 1.0)], "dt date, v double")
    for bad, message in ((twice, "more than one row per day"), (far, "1900-2299")):
        with pytest.raises(Exception, match=message):
            panel.join_macro(b, bad).collect()


def test_asof_takes_the_latest_known_value(spark):
    series = spark.createDataFrame([(DAY0 - dt.timedelta(days=9), 1.0), (DAY0 + dt.timedelta(days=1), None), (DAY0 + dt.timedelta(days=2), 3.0)], "dt date, v double")
    assert column(panel.asof_macro(bars(spark, [1.0] * 4), series), "v") == [1.0, 1.0, 3.0, 3.0]


def test_effective_rates_agree_in_both_forms(spark):
    steps = [("2024-01-02", 5.0), ("2024-01-04", 6.0)]
    b = bars(spark, [1.0] * 5)
    table = spark.createDataFrame(steps, "d string, rate double").select(F.col("d").cast("date").alias("eff_date"), "rate")
    assert column(panel.effective_lookup(b, steps), "rate") == [None, 5.0, 5.0, 6.0, 6.0]
    assert column(panel.effective_join(b, table), "rate") == [None, 5.0, 5.0, 6.0, 6.0]


def test_upsert_and_high_water(spark):
    b = bars(spark, [1.0, 2.0, 3.0])
    newer = bars(spark, [9.0, 2.5, 3.0]).filter(F.col("close") == 9.0)
    assert column(panel.upsert(b, newer, ["ticker", "dt"]), "close") == [9.0, 2.0, 3.0]
    passed = panel.after_high_water(b.union(bars(spark, [7.0], "B")), b.filter("close < 2.5"))
    assert column(passed, "close") == [3.0, 7.0]


def test_forbidden_and_required_columns(spark):
    b = bars(spark, [1.0])
    with pytest.raises(ValueError):
        panel.assert_no_forbidden(b, ["open"])
    with pytest.raises(ValueError):
        panel.assert_required(b, ["rate"])
    assert panel.feature_columns(b, ["volume"]) == ["open", "high", "low", "close"]


def test_weekly_bars_end_on_friday(spark):
    weekly = panel.resample_weekly(bars(spark, [float(i) for i in range(1, 13)])).orderBy("week").collect()
    # 1 January 2024 is a Monday
    assert [str(r["week"]) for r in weekly] == ["2024-01-05", "2024-01-12"]
    assert [(r["open"], r["close"], r["high"]) for r in weekly] == [(1.0, 5.0, 6.0), (6.0, 12.0, 13.0)]
