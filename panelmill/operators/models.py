"""Fitting, scoring and comparing forecasts as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from panelmill.functions.columns import apply_threshold, relative_lift, significant, snap, squared_loss
from panelmill.operators import panel, splits, stats, trees
from panelmill.operators.panel import DATE, KEY


def score_and_decide(scores: DataFrame, p: str, share: float = 0.40, key: str = KEY) -> DataFrame:
    """Percentile threshold of the validation scores applied to the test rows of the same key."""
    t = stats.percentile_threshold(scores.filter("split = 'val'"), p, share, key).withColumn("threshold", snap("threshold", 9))
    return scores.filter("split = 'test'").join(t, key).withColumn("decision", apply_threshold(p, "threshold"))


def compare_feature_sets(scores: DataFrame, a: str = "endo", b: str = "exo", key: str = KEY, label: str = "sector") -> DataFrame:
    """One row per key: metrics, AUC, DM, lift and significance of two scores on the same rows.

    Thresholds and ranks are windows inside the key, the report one aggregate over it: the scored
    table is read once and never joined with itself, and a table partitioned by key is not shuffled.
    What the other rows give is counted before the ranks, so only test rows are sorted by score; keys
    without test rows or with several labels keep all rows.
    """
    own = Window.partitionBy(key)
    test, y = F.col("split") == "test", F.col("y")
    one_label = F.min(label).over(own).eqNullSafe(F.max(label).over(own)) & F.count(label).over(own).isin(0, F.count(F.lit(1)).over(own))
    staged = scores.withColumns(
        {f"{m}_threshold": snap(F.percentile(F.when(F.col("split") == "val", F.col(f"p_{m}")), F.lit(0.4)).over(own), 9) for m in (a, b)}
        | {
            "_whole": ~one_label | (F.count_if(test).over(own) == 0),
            "_samples": F.count(F.lit(1)).over(own),
            "_ratio": F.avg(F.when(F.col("split") == "train", y)).over(own),
        }
    )
    staged = staged.filter(F.col("_whole") | test)
    for m in (a, b):
        # average rank within the test rows of the key: rank plus half of the further ties
        order = Window.partitionBy(key, "split").orderBy(f"p_{m}")
        ties = F.count(F.lit(1)).over(order.rangeBetween(0, 0))
        staged = staged.withColumn(f"{m}_rank", F.rank().over(order) + (ties - 1) / 2.0)
    d = F.when(test, squared_loss("y", f"p_{a}") - squared_loss("y", f"p_{b}"))
    aggs = {
        "samples": F.when(F.max("_whole"), F.count(F.lit(1))).otherwise(F.max("_samples")),
        "train_pos_ratio": F.when(F.max("_whole"), F.avg(F.when(F.col("split") == "train", y))).otherwise(F.max("_ratio")),
        "test": F.count_if(test),
        "n": F.count(d), "d_bar": F.avg(d), "g0": F.var_samp(d),
        "pos": F.count_if(test & (y == 1)),
    }
    for m in (a, b):
        yes = F.col(f"p_{m}") >= F.col(f"{m}_threshold")
        aggs |= {
            f"{m}_threshold": F.max(f"{m}_threshold"),
            f"{m}_tp": F.count_if(test & (y == 1) & yes), f"{m}_fp": F.count_if(test & (y == 0) & yes),
            f"{m}_fn": F.count_if(test & (y == 1) & ~yes), f"{m}_tn": F.count_if(test & (y == 0) & ~yes),
            f"{m}_rank": F.sum(F.when(test & (y == 1), F.col(f"{m}_rank"))),
        }
    out = staged.groupBy(key, label).agg(*[c.alias(n) for n, c in aggs.items()])
    pos, neg = F.col("pos"), F.col("test") - F.col("pos")
    for m in (a, b):
        cells = [F.col(f"{m}_{c}") for c in ("tp", "fp", "fn", "tn")]
        out = out.withColumns({f"{m}_{n}": c for n, c in stats.metric_columns(*cells).items()})
        out = out.withColumn(f"{m}_auc", F.try_divide(F.col(f"{m}_rank") - pos * (pos + 1) / 2.0, (pos * neg).cast("double")))
    v = F.col("g0") / F.col("n")
    dm = F.when((F.col("n") >= 10) & (v > 0), F.col("d_bar") / F.sqrt(v))
    out = out.withColumns({"dm_stat": snap(dm, 6), "f1_lift": relative_lift(f"{a}_f1", f"{b}_f1")})
    return out.select(
        key, label, "samples", "train_pos_ratio", "test",
        *[f"{m}_{c}" for m in (a, b) for c in ("f1", "precision", "recall", "threshold", "auc")],
        "f1_lift",
        (F.col(f"{b}_auc") - F.col(f"{a}_auc")).alias("auc_lift"),
        (F.col(f"{b}_f1") > F.col(f"{a}_f1")).alias(f"{b}_better"),
        "dm_stat",
        significant("dm_stat", "test", "f1_lift").alias("significant"),
    )


# Fewest samples of a ticker, lowest F1 of its baseline; macro series by their treatment.
MIN_SAMPLES, MIN_BASELINE_F1 = 200, 0.25
CHANGES = ("usd_egp", "gold_local", "sp500", "oil", "gold_intl")
LEVELS = ("cbe_rate", "inflation", "vix")


def with_p_value(report: DataFrame, dm: str = "dm_stat", n: str = "test") -> DataFrame:
    """Two-sided p-value of the DM statistic with n - 1 degrees; null without a statistic."""
    return report.withColumn("p_value", stats.p_value_t(dm, F.col(n) - 1))


def run_experiment(
    bars: DataFrame, macro: DataFrame, settings: trees.Settings = trees.BOOSTED, min_samples: int = MIN_SAMPLES, min_f1: float = MIN_BASELINE_F1,
    changes: tuple[str, ...] = CHANGES, levels: tuple[str, ...] = LEVELS, key: str = KEY, label: str = "sector",
) -> DataFrame:
    """Do macro series improve the weekly direction forecast? One row per ticker: two boosted ensembles on the same window samples, one
    with the price features only, thresholds at the 40th percentile of validation, metrics, DM with p-value, lift.

    `macro` has one row per date; of the series named in `changes` and `levels` those that it has are used. Tickers with fewer than `min_samples`
    samples or a baseline F1 below `min_f1` have no row. Bars are shuffled once by ticker: samples, splits, standardisation
    and both fits share that partitioning.
    """
    changes, levels = (tuple(c for c in names if c in macro.columns) for names in (changes, levels))
    merged = panel.fill_columns(panel.join_macro(trees.spread(bars, key), macro.select(DATE, *changes, *levels)), [*changes, *levels], backfill=True)
    samples = panel.window_samples(merged, changes=changes, levels=levels)
    exo = [c for c in samples.columns if c.startswith(("ret_", "cumret_", "vol_change", "macro_"))]
    endo = [c for c in exo if not c.startswith("macro_")]
    split = splits.purged_split(samples).filter(F.col("n_rows") >= min_samples)
    scaled = splits.standardise(split, exo, F.col("split") == "train", key=key)
    scored = trees.fit_nested_sets(scaled, {"endo": endo, "exo": exo}, "target", key, DATE, settings, keep=(label,))
    sized = scored.withColumnsRenamed({"target": "y"})
    # the number of trees is one value a ticker; it travels through the report's aggregate in the label
    tag = F.struct(label, "trees_endo", "trees_exo").alias("_tag")
    report = compare_feature_sets(sized.select(key, DATE, "split", "y", *[snap(f"p_{m}", 9).alias(f"p_{m}") for m in ("endo", "exo")], tag), label="_tag")
    report = with_p_value(report).withColumn("significant", F.coalesce((F.col("p_value") < 0.05) & (F.col("dm_stat") > 0) & (F.col("f1_lift") > 0), F.lit(False)))
    named = report.select(
        key, F.col(f"_tag.{label}").alias(label), F.col("_tag.trees_endo").alias("endo_trees"), F.col("_tag.trees_exo").alias("exo_trees"),
        *[c for c in report.columns if c not in (key, "_tag")],
    )
    return eligible_baseline(named, min_f1)


def eligible_baseline(report: DataFrame, min_f1: float = 0.25, n_a: str | None = None, n_b: str | None = None) -> DataFrame:
    """Keys with a usable baseline and, where both counts are given, the same rows in both feature sets."""
    out = report.filter(F.col("endo_f1") >= min_f1)
    return out.filter(F.col(n_a) == F.col(n_b)) if n_a and n_b else out


# Digits of the report's columns.
REPORT_DIGITS = {"train_pos_ratio": 3, "threshold": 2, "dm_stat": 4, "p_value": 6}


def rounded_report(report: DataFrame) -> DataFrame:
    """Report values rounded as published: four digits unless listed."""
    out = {}
    for name, kind in report.dtypes:
        if kind == "double":
            digits = REPORT_DIGITS.get(name, REPORT_DIGITS.get(name.split("_", 1)[-1], 4))
            out[name] = snap(name, digits)
    return report.withColumns(out)
