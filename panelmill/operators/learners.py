"""Learners as Spark jobs: pooled tree ensembles from the ML library, one logistic fit per key.

A per-key fit gets the rows of one ticker (and window and fold), which the calendar bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from panelmill.functions.columns import relative_lift, snap, squared_loss
from panelmill.operators import splits, stats, trees
from panelmill.operators.panel import DATE, KEY
from panelmill.session import materialise

# Published settings of the learners.
BOOSTED = {"maxDepth": 6, "stepSize": 0.03, "maxIter": 1000}
FOREST = {"numTrees": 500, "maxDepth": 10, "minInstancesPerNode": 4}
HIST_BOOSTED = {"maxDepth": 8, "stepSize": 0.05, "maxIter": 1000, "maxBins": 256}
LOGISTIC_C = 0.1
KEYS_AT_ONCE = 64  # keys of a partition whose logistic fits run together
CELLS = 1 << 21  # numbers of the matrices that are fitted side by side
MIN_TEST_ROWS = 30  # of a tournament window
WINDOWS = {"Reactionary": 126, "Tactical": 378, "Strategic": 756}


def _assembled(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.fillna(0, subset=features)).withColumn(
        "label", F.col(target).cast("double")
    )


def _weighted(df: DataFrame, target: str, key: str) -> DataFrame:
    return splits.class_weights(df, target, key)


def fit_boosted(df: DataFrame, features: list[str], target: str, settings: dict | None = None, key: str = KEY):
    """Boosted trees on the rows with split train and val; val stops the boosting early."""
    rows = _weighted(df.filter(F.col("split").isin("train", "val")), target, key)
    rows = _assembled(rows, features, target).withColumn("is_val", F.col("split") == "val")
    gbt = GBTClassifier(weightCol="weight", validationIndicatorCol="is_val", seed=42, **{**BOOSTED, **(settings or {})})
    return gbt.fit(rows)


def fit_hist_boosted(df: DataFrame, features: list[str], target: str, settings: dict | None = None, key: str = KEY):
    return fit_boosted(df, features, target, {**HIST_BOOSTED, **(settings or {})}, key)


def fit_forest(df: DataFrame, features: list[str], target: str, settings: dict | None = None, key: str = KEY):
    rows = _assembled(_weighted(df.filter("split = 'train'"), target, key), features, target)
    return RandomForestClassifier(weightCol="weight", seed=42, **{**FOREST, **(settings or {})}).fit(rows)


def score_model(model, df: DataFrame, features: list[str], target: str) -> DataFrame:
    scored = model.transform(_assembled(df, features, target))
    return scored.withColumn("p", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")


def feature_importance(model, spark, features: list[str]) -> DataFrame:
    """One row per feature of a fitted ensemble."""
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


# ------------------------------------------------------------------- logistic per key


def logistic_fit(x: np.ndarray, y: np.ndarray, c: float, balanced: bool = True, steps: int = 50) -> tuple[np.ndarray, float]:
    """L2 logistic regression by Newton steps with halving: c * sum of weighted losses + |w|^2 / 2, free intercept."""
    return logistic_fits([(x, y)], c, balanced, steps)[0]


def logistic_fits(parts: list[tuple[np.ndarray, np.ndarray]], c: float, balanced: bool = True, steps: int = 50) -> list[tuple[np.ndarray, float]]:
    """`logistic_fit` of every (x, y), those of like length side by side; shorter ones are filled up with rows of weight 0."""
    order, found, at = sorted(range(len(parts)), key=lambda i: len(parts[i][1])), [None] * len(parts), 0
    while at < len(order):
        shortest, width, end = len(parts[order[at]][1]), parts[order[at]][0].shape[1] + 1, at + 1
        while end < len(order) and (n := len(parts[order[end]][1])) <= 1.2 * shortest + 8 and (end + 1 - at) * n * width <= CELLS:
            end += 1
        together, at = order[at:end], end
        n, k = len(parts[together[-1]][1]), parts[together[0]][0].shape[1]
        xb, y, w = np.zeros((len(together), n, k + 1)), np.zeros((len(together), n)), np.zeros((len(together), n))
        for i, place in enumerate(together):
            own, labels = parts[place]
            m = len(labels)
            xb[i, :m, :k], xb[i, :m, k], y[i, :m], w[i, :m] = own, 1.0, labels, 1.0
            if balanced:
                for value in (0, 1):
                    members = (labels == value).sum()
                    w[i, :m][labels == value] = m / (2 * members) if members else 0
        for place, beta in zip(together, _newton(xb, y, w, c, steps), strict=True):
            found[place] = (beta[:k], float(beta[k]))
    return found


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: float, steps: int) -> np.ndarray:
    """Coefficients of each fit, the last the intercept; a fit that has arrived stays while the others go on."""
    count, _, k = x.shape
    penalty = np.append(np.ones(k - 1), 0.0)
    ridge = np.diag(penalty) + 1e-12 * np.eye(k)
    out, going = np.zeros((count, k)), np.arange(count)

    def loss(some, b):
        z = np.matmul(x[some], b[:, :, None])[:, :, 0]
        return c * np.sum(w[some] * (np.logaddexp(0, z) - y[some] * z), axis=1) + 0.5 * np.sum(penalty * b * b, axis=1)

    now = loss(slice(None), out)
    for _ in range(steps):
        beta = out[going]
        p = 1 / (1 + np.exp(-np.clip(np.matmul(x, beta[:, :, None])[:, :, 0], -35, 35)))
        g = c * np.matmul((w * (p - y))[:, None, :], x)[:, 0] + penalty * beta
        h = c * np.matmul(x.transpose(0, 2, 1) * (w * p * (1 - p))[:, None, :], x) + ridge
        step, size = np.linalg.solve(h, g[:, :, None])[:, :, 0], np.ones(len(going))
        fresh = beta - step
        after = loss(slice(None), fresh)
        worse = np.flatnonzero(after > now)
        while len(worse):
            size[worse] /= 2
            fresh[worse] = beta[worse] - size[worse, None] * step[worse]
            after[worse] = loss(worse, fresh[worse])
            worse = worse[(size[worse] > 1e-8) & (after[worse] > now[worse])]
        out[going] = fresh
        done = (np.max(np.abs(size[:, None] * step), axis=1) < 1e-10) | (now - after < 1e-14 * np.maximum(1.0, np.abs(now)))
        if done.all():
            break
        left = ~done
        going, now = going[left], after[left]
        if done.any():
            x, y, w = x[left], y[left], w[left]
    return out


def _standardised_fits(parts: list[tuple[np.ndarray, np.ndarray]], c: float, balanced: bool) -> list[tuple]:
    """(mu, sigma, coefficients, intercept) of each (x, y), on standardised columns (population deviation, 0 -> 1), in a fixed order of its rows."""
    scaled, scales = [], []
    for x, y in parts:
        order = np.lexsort((y, *x.T[::-1]))
        x, y = x[order], y[order]
        mu, sigma = x.mean(axis=0), x.std(axis=0)
        sigma[sigma == 0] = 1.0
        scaled.append(((x - mu) / sigma, y))
        scales.append((mu, sigma))
    return [(*scale, *fit) for scale, fit in zip(scales, logistic_fits(scaled, c, balanced), strict=True)]


def _matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in columns], axis=1) if columns else np.zeros((table.num_rows, 0))


def _together(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key side by side in one partition, without an exchange where they already are: what a window over the key needs."""
    return df.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys))).sortWithinPartitions(*keys)


def fit_logistic_per_key(
    df: DataFrame, features: list[str], target: str, keys: list[str], c: float = LOGISTIC_C, balanced: bool = True, min_rows: int = 2
) -> DataFrame:
    """Coefficients per key, on standardised training rows (population deviation, 0 -> 1).

    `df` holds training rows only. Keys with one class have no fit. The fits of `KEYS_AT_ONCE` keys run side by side.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n_train long, mu array<double>, sigma array<double>, coef array<double>, intercept double"
    out = trees._arrow(df.sparkSession, schema)
    columns = [f"_x{i}" for i in range(len(features))]

    def run(batches):
        for tables in trees._groups(batches, keys, KEYS_AT_ONCE):
            whole = pa.concat_tables(tables)
            x, y, ends = _matrix(whole, columns), whole["_y"].to_numpy(), np.cumsum([t.num_rows for t in tables])
            parts = [(x[a:b], y[a:b]) for a, b in zip((0, *ends[:-1]), ends, strict=True)]
            kept = [i for i, (_, y) in enumerate(parts) if len(y) >= min_rows and y.min() != y.max()]
            rows = []
            for i, (mu, sigma, coef, intercept) in zip(kept, _standardised_fits([parts[i] for i in kept], c, balanced), strict=True):
                head = {k: tables[i][k][0].as_py() for k in keys}
                rows.append({**head, "n_train": len(parts[i][1]), "mu": mu.tolist(), "sigma": sigma.tolist(), "coef": coef.tolist(), "intercept": intercept})
            yield from pa.Table.from_pylist(rows, schema=out).to_batches()

    numbers = [F.col(f).cast("double").alias(x) for f, x in zip(features, columns, strict=True)]
    rows = df.select(*keys, *numbers, F.col(target).cast("double").alias("_y")).fillna(0.0, subset=columns)
    return _together(rows, keys).mapInArrow(run, schema)


def score_logistic(df: DataFrame, fits: DataFrame, features: list[str], keys: list[str], out: str = "p") -> DataFrame:
    """Probability from the coefficient table; a join and column arithmetic, nothing in Python."""
    z = F.col("intercept")
    for i, f in enumerate(features):
        z = z + (F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.col("mu")[i]) / F.col("sigma")[i] * F.col("coef")[i]
    joined = df.join(fits.select(*keys, "mu", "sigma", "coef", "intercept"), keys)
    return joined.withColumn(out, 1 / (1 + F.exp(-z))).drop("mu", "sigma", "coef", "intercept")


def logistic_slopes(train: DataFrame, fits: DataFrame, features: list[str], target: str, keys: list[str], c: float = LOGISTIC_C) -> DataFrame:
    """(keys, n_train, slope): the largest absolute slope of the balanced penalised loss at the coefficients of `fits`, by one aggregate."""
    scored = score_logistic(train, fits, features, keys, "_p").join(fits.select(*keys, "mu", "sigma", "coef"), keys)
    ones = F.sum(F.col(target)).over(Window.partitionBy(*keys))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    weighted = scored.withColumn("_r", (F.col("_p") - F.col(target)) * n / (2 * F.when(F.col(target) == 1, ones).otherwise(n - ones)))
    z = [(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - F.col("mu")[i]) / F.col("sigma")[i] for i, f in enumerate(features)]
    sums = [(F.sum(F.col("_r") * x) * c + F.first("coef")[i]) for i, x in enumerate(z)] + [F.sum("_r") * c]
    return weighted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), F.greatest(*[F.abs(s) for s in sums]).alias("slope"))


def prune_collinear(pairs: list[tuple[str, str, float]], importance: dict[str, float], ties: str = "first") -> list[str]:
    """Features to drop, in order: of each pair not yet hit, the less important one.

    A greedy pass over pairs of a fixed column list; the correlations and importances come from Spark.
    """
    dropped: list[str] = []
    for a, b, _ in pairs:
        if a in dropped or b in dropped:
            continue
        x, y = importance.get(a, 0.0), importance.get(b, 0.0)
        dropped.append(a if (x <= y if ties == "first" else x < y) else b)
    return dropped


def prune_by_importance(df: DataFrame, features: list[str], target: str, threshold: float = 0.85) -> list[str]:
    """Strongest pairs first; importance is mutual information with the target."""
    pairs = [tuple(r) for r in stats.correlated_pairs(df, features, threshold).collect()]
    scores = {r["feature"]: r["importance"] for r in stats.mutual_information(df, features, target).collect()} if pairs else {}
    return prune_collinear(pairs, scores)


def prune_by_target(df: DataFrame, features: list[str], target: str, threshold: float = 0.85) -> list[str]:
    """Pairs in column order; importance is |correlation with the target|."""
    place = {f: i for i, f in enumerate(features)}
    rows = stats.correlated_pairs(df, features, threshold).collect()
    pairs = sorted((tuple(r) for r in rows), key=lambda r: (place[r[0]], place[r[1]]))
    scores = {r["feature"]: abs(r["corr"] or 0.0) for r in stats.target_correlation(df, features, target).collect()} if pairs else {}
    return prune_collinear(pairs, scores, ties="second")


# -------------------------------------------------------------------------- tournament


def walk_forward_tournament(
    df: DataFrame, target: str, feature_sets: dict[str, list[str]], windows: dict[str, int], test: int = 63, c: float = LOGISTIC_C, key: str = KEY
) -> DataFrame:
    """One row per (ticker, window): metrics of two feature sets averaged over walk-forward folds, lift, DM and its p-value.

    Metrics are those of each fold, then their mean; the DM statistic pools the test rows of all folds. A training fold with one
    class gives no fold, and a window with fewer than `MIN_TEST_ROWS` test rows gives no row.

    The rows of a ticker stay together: a row carries its features into every (window, fold, role), and the folds of a ticker are
    fitted for both sets, and their test rows scored, in one pass. A fit has at most window rows.
    """
    name_a, name_b = feature_sets
    columns = sorted({c for cols in feature_sets.values() for c in cols})
    table = materialise(df.select(key, DATE, target, *columns), "tournament")
    rows = splits.walk_forward_folds(table, windows, test, key=key)
    return tournament_report(fit_and_score_folds(rows, target, feature_sets, [key, "window", "fold"], c), target, name_a, name_b, key)


def fit_and_score_folds(rows: DataFrame, target: str, feature_sets: dict[str, list[str]], keys: list[str], c: float = LOGISTIC_C) -> DataFrame:
    """(keys, target, p_<set>) of the rows with role test, by the fits of the rows of their keys with role train.

    As `fit_logistic_per_key` and `score_logistic` for each set; keys that are null or whose training rows have one class give no row.
    """
    place = {f: i for i, f in enumerate(sorted({f for cols in feature_sets.values() for f in cols}))}
    kinds, columns = dict(rows.dtypes), [f"_x{i}" for i in place.values()]
    fields = [*keys, target]
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in fields) + "".join(f", `p_{name}` double" for name in feature_sets)
    out = trees._arrow(rows.sparkSession, schema)

    def run(batches):
        for tables in trees._groups(batches, keys, KEYS_AT_ONCE):
            whole = pa.concat_tables(tables)
            x, y, tested = _matrix(whole, columns), whole["_y"].to_numpy(), whole["_test"].to_numpy()
            parts, kept, ends = [], np.zeros(len(y), bool), np.cumsum([t.num_rows for t in tables])
            for a, b in zip((0, *ends[:-1]), ends, strict=True):
                train, test = a + np.flatnonzero(~tested[a:b]), a + np.flatnonzero(tested[a:b])
                if len(test) and len(train) >= 2 and y[train].min() != y[train].max():
                    parts.append((np.where(np.isnan(x[train]), 0.0, x[train]), y[train], x[test]))
                    kept[test] = True
            found = whole.filter(pa.array(kept)).select(fields)
            for name, features in feature_sets.items():
                own = [place[f] for f in features]
                fits = _standardised_fits([(x[:, own], y) for x, y, _ in parts], c, True)
                z = [b + ((x[:, own] - mu) / sigma) @ w for (mu, sigma, w, b), (_, _, x) in zip(fits, parts, strict=True)]
                with np.errstate(over="ignore"):
                    found = found.append_column(f"p_{name}", pa.array(1 / (1 + np.exp(-np.concatenate([np.zeros(0), *z])))))
            yield from found.cast(out).combine_chunks().to_batches()

    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for f, i in place.items()]
    staged = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).select(
        *fields, *numbers, F.col(target).cast("double").alias("_y"), (F.col("role") == "test").alias("_test")
    )
    return _together(staged, keys).mapInArrow(run, schema)


def tournament_report(scored: DataFrame, target: str, name_a: str, name_b: str, key: str = KEY) -> DataFrame:
    """The tournament's rows from test rows (key, window, fold, target, p_<a>, p_<b>).

    One aggregate per fold keeps counts and the sums of the loss difference; the means and the pooled statistic follow from those.
    """
    d = squared_loss(target, f"p_{name_a}") - squared_loss(target, f"p_{name_b}")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(d).alias("d_bar"), F.var_pop(d).alias("d_var")]
    for name in (name_a, name_b):
        hit = F.col(f"p_{name}") > 0.5
        y = F.col(target)
        aggs += [
            F.count_if((y == 1) & hit).alias(f"{name}_tp"), F.count_if((y == 0) & hit).alias(f"{name}_fp"),
            F.count_if((y == 1) & ~hit).alias(f"{name}_fn"), F.count_if((y == 0) & ~hit).alias(f"{name}_tn"),
        ]
    measures = ("f1", "precision", "recall")
    folds = scored.groupBy(key, "window", "fold").agg(*aggs)
    for name in (name_a, name_b):
        m = stats.metric_columns(*[F.col(f"{name}_{x}") for x in ("tp", "fp", "fn", "tn")])
        folds = folds.withColumns({f"{name}_{x}": m[x] for x in measures})
    means = [F.avg(f"{name}_{x}").alias(f"{name}_{x}") for x in measures for name in (name_a, name_b)]
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("d_bar"))
    # squares around the pooled mean: inside the folds, and of the folds' means by the differences of pairs of sums
    squares = F.sum(F.col("n") * F.col("d_var")) + F.sum(F.col("n") * F.col("d_bar") * F.col("d_bar")) - total * total / n
    out = folds.groupBy(key, "window").agg(n.alias("n"), F.count(F.lit(1)).alias("n_folds"), (total / n).alias("d_bar"), squares.alias("squares"), *means)
    out = out.filter(F.col("n") >= MIN_TEST_ROWS)
    v = snap(F.col("squares"), 12) / (F.col("n") - 1) / F.col("n")
    out = out.withColumn("dm", F.when(v > 0, F.col("d_bar") / F.sqrt(v)))
    out = out.withColumn("p_value", stats.p_value_t("dm", F.col("n") - 1))
    out = out.withColumn("lift_pct", relative_lift(f"{name_a}_f1", f"{name_b}_f1", "null", 100.0))
    scores = [f"{name}_{x}" for x in measures for name in (name_a, name_b)]
    return out.select(key, "window", "n", "n_folds", *scores, "dm", "p_value", "lift_pct", F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"))


def tournament_winners(report: DataFrame, key: str = KEY) -> DataFrame:
    return stats.best_per_key(report, key, "lift_pct", "window")


# ------------------------------------------------------------------ threshold strategies


def trade_summary(scores: DataFrame, thresholds: DataFrame, p: str, r: str, keys: list[str]) -> DataFrame:
    """Sharpe, CAGR, win rate and count of the test rows at or above the key's threshold; zeros below ten trades."""
    trades = F.when(F.col(p) >= F.col("threshold"), F.col(r))
    g = scores.join(thresholds, keys).groupBy(*keys, "threshold").agg(
        F.count(trades).alias("n"),
        stats.sharpe(F.count(trades), F.avg(trades), F.stddev_pop(trades)).alias("sharpe"),
        stats.cagr_column(trades).alias("cagr"),
        stats.win_rate_column(trades).alias("win_rate"),
    )
    enough = F.col("n") >= stats.MIN_TRADES
    zero = lambda c: F.when(enough, F.col(c)).otherwise(0.0).alias(c)
    return g.select(*keys, "threshold", zero("sharpe"), zero("cagr"), zero("win_rate"), F.when(enough, F.col("n")).otherwise(0).alias("n_trades"))


def sharpe_training(scores: DataFrame, p: str, r: str, key: str = KEY) -> DataFrame:
    """Threshold with the best validation Sharpe, applied to the test rows."""
    best = stats.sharpe_threshold_sweep(scores.filter("split = 'val'"), p, r, key=key).select(key, "threshold")
    return trade_summary(scores.filter(F.col("split") == "test"), best, p, r, [key])


def strategy_grid(scores: DataFrame, sets: dict[str, str], r: str, key: str = KEY) -> DataFrame:
    """Each feature set with each threshold rule: precision, mean return and trades on the test rows."""
    out = None
    scores = materialise(scores.filter("split in ('val', 'test')"), "strategies")
    val, test = scores.filter("split = 'val'"), scores.filter("split = 'test'")
    for name, p in sets.items():
        rules = {
            "percentile": stats.percentile_threshold(val, p, 0.40, key).withColumn("threshold", snap("threshold", 9)),
            "sharpe": stats.sharpe_threshold_sweep(val, p, r, key=key).select(key, "threshold"),
        }
        both = None
        for rule, table in rules.items():
            one = table.select(key, "threshold", F.lit(f"{name}_{rule}").alias("strategy"))
            both = one if both is None else both.unionByName(one)
        hit = F.col(p) >= F.col("threshold")
        g = test.join(both, key).groupBy(key, "strategy", "threshold").agg(
            F.count_if(hit).alias("trade_count"),
            F.coalesce(F.avg(F.when(hit, F.col("y"))), F.lit(0.0)).alias("precision"),
            F.coalesce(F.avg(F.when(hit, F.col(r))), F.lit(0.0)).alias("mean_return"),
        )
        out = g if out is None else out.unionByName(g)
    return out
