"""Tree ensembles per key against a plain recursive tree, and the rule that stops them."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import models, splits, trees
from panelmill.plans.q_models import ENDO, EXO
from panelmill.plans.views import Tables

FOLDER = "/root/testdata/sf0.001"


def middles(x):
    values = [np.unique(c) for c in x.T]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def plain_tree(x, g, h, depth, l2, least, cuts):
    """A tree by exhaustive search over all thresholds, one node at a time."""
    value = -g.sum() / (h.sum() + l2)
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            for v in cuts[f]:
                left = x[:, f] <= v
                if min(left.sum(), (~left).sum()) < least:
                    continue
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + l2) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + l2)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, v))
    if best[1] is None:
        return lambda z: np.full(len(z), value)
    f, v = best[1]
    left = x[:, f] <= v
    low, high = (plain_tree(x[m], g[m], h[m], depth - 1, l2, least, cuts) for m in (left, ~left))
    return lambda z: np.where(z[:, f] <= v, low(z), high(z))


def plain_even_tree(x, g, h, depth, l2, cuts):
    """One split for all nodes of a level, by exhaustive search."""
    node, chosen = np.zeros(len(x), int), []
    for _ in range(depth):
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for v in cuts[f]:
                left, gain = x[:, f] <= v, 0.0
                for k in np.unique(node):
                    m = node == k
                    if (m & left).any() and (m & ~left).any():
                        gain += sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (m & left, m & ~left)) - g[m].sum() ** 2 / (h[m].sum() + l2)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, v))
        if best[1] is None:
            break
        chosen.append(best[1])
        node = 2 * node + (x[:, best[1][0]] > best[1][1])
    values = {k: -g[node == k].sum() / (h[node == k].sum() + l2) for k in np.unique(node)}

    def score(z):
        at = np.zeros(len(z), int)
        for f, v in chosen:
            at = 2 * at + (z[:, f] > v)
        return np.array([values.get(k, 0.0) for k in at])

    return score


def plain_boost(x, y, x_val, y_val, s, rounds):
    """Staged scores of `rounds` trees."""
    w = trees.balanced(y)
    score, staged = np.zeros(len(y)), np.zeros(len(x_val))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        tree = plain_even_tree(x, g, h, s.depth, s.l2, middles(x)) if s.even else plain_tree(x, g, h, s.depth, s.l2, s.least, middles(x))
        score, staged = score + s.rate * tree(x), staged + s.rate * tree(x_val)
    return staged


@pytest.fixture(scope="module")
def samples(spark):
    return splits.purged_split(Tables(spark, FOLDER).samples)


@pytest.mark.parametrize("even", [True, False])
def test_three_tickers_against_plain_trees(spark, samples, even):
    s = trees.Settings(trees=4, depth=3, rate=0.1, l2=3.0, least=1 if even else 5, even=even, bins=10_000, patience=50)
    tickers = [r.ticker for r in samples.groupBy("ticker").count().orderBy(F.desc("count"), "ticker").limit(3).collect()]
    df = samples.filter(F.col("ticker").isin(tickers))
    found = {r.ticker: r for r in trees.fit_boosted_per_key(df, ENDO, "target", settings=s).collect()}
    assert sorted(found) == sorted(tickers)
    scored = trees.score_per_key(df, trees.fit_boosted_per_key(df, ENDO, "target", settings=s), ENDO).collect()
    for t in tickers:
        rows = sorted((r for r in scored if r.ticker == t), key=lambda r: r.dt)
        x = np.array([[r[f] or 0.0 for f in ENDO] for r in rows])
        y = np.array([r.target for r in rows], float)
        part = np.array([r.split or "" for r in rows])
        train = part == "train"
        staged = plain_boost(x[train], y[train], x, y, s, found[t].n_trees)
        assert np.abs(1 / (1 + np.exp(-staged)) - np.array([r.p for r in rows])).max() < 1e-9
        assert 1 <= found[t].n_trees <= found[t].n_tried <= 4 and found[t].n_train == train.sum()
        assert sum(found[t].importance) == pytest.approx(1)


def test_patience_on_a_known_minimum():
    scores = [1, 3, 5, 5, 4, 4, 4]
    assert trees.best_prefix(scores, 4) == (3, True) and trees.best_prefix(scores, 5) == (3, False)
    assert trees.best_prefix(scores[:3], 1) == (3, False)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    s = trees.Settings(trees=400, depth=3, rate=0.3, l2=1.0, bins=300, patience=20, metric="logloss")
    m = trees.boost(x[:200], y[:200], x[200:], y[200:], s)
    losses = []  # every prefix scored by itself
    full = trees.boost(x[:200], y[:200], x[200:], y[200:], replace(s, patience=10**6))
    assert full["n_tried"] == 400
    for k in range(1, 60):
        prefix = trees.boost(x[:200], y[:200], x[200:], y[200:], replace(s, trees=k, patience=10**6))
        losses.append(-prefix["best"] if prefix["n_trees"] == k else np.inf)
    assert m["n_trees"] == int(np.argmin(losses)) + 1 == full["n_trees"] and m["n_tried"] == m["n_trees"] + 20
    assert len(m["roots"]) == m["n_trees"]


def test_forest_and_leaf_budget():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 1] > 0).astype(float)
    s = replace(trees.FOREST, trees=60)
    m = trees.forest(x[:300], y[:300], x[:0], y[:0], s)
    p = trees.predict(m, x[300:])
    assert ((p >= 0) & (p <= 1)).all() and ((p > 0.5) == (y[300:] == 1)).mean() > 0.95
    assert int(np.argmax(m["importance"])) == 1 and m["n_trees"] == 60
    again = trees.forest(x[:300], y[:300], x[:0], y[:0], s)
    assert again == m
    s = replace(trees.HIST_BOOSTED, trees=30, patience=30, leaves=5, least=3)
    m = trees.boost(x, (rng.random(400) > 0.5).astype(float), x[:0], y[:0], s)
    ends = [*m["roots"][1:], len(m["feature"])]
    for a, b in zip(m["roots"], ends, strict=True):
        assert sum(f < 0 for f in m["feature"][a:b]) <= 5
    assert trees.boost(x, np.ones(400), x[:0], y[:0], s) is None and trees.forest(x[:0], y[:0], x[:0], y[:0], s) is None


def test_bins_hold_even_shares():
    column = np.repeat(np.arange(1000.0), 3)[:, None]
    edges = trees.bin_edges(column, 16)
    counts = np.bincount(trees.coded(column, edges)[:, 0])
    assert len(counts) == 16 and counts.max() < 1.1 * counts.min()
    assert trees.bin_edges(np.array([[1.0], [1.0], [3.0]]), 16)[0].tolist() == [2.0]


def test_nested_sets_share_their_rows(spark, samples):
    s = replace(trees.BOOSTED, trees=15, depth=3)
    both = trees.fit_nested_sets(samples, {"endo": ENDO, "exo": EXO}, "target", settings=s)
    rows = both.collect()
    for name, features in (("endo", ENDO), ("exo", EXO)):
        fits = trees.fit_boosted_per_key(samples, features, "target", settings=s)
        alone = {(r.ticker, r.dt): r.p for r in trees.score_per_key(samples, fits, features).collect()}
        assert len(rows) == len(alone) and all(abs(r[f"p_{name}"] - alone[r.ticker, r.dt]) < 1e-12 for r in rows)
    fresh = trees.fit_nested_sets(splits.purged_split(Tables(spark, FOLDER).samples), {"endo": ENDO, "exo": EXO}, "target", settings=s)
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(ticker") == 1


def test_run_experiment(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    macro = t.macro.select("dt", F.col("usd_sell_rate").alias("usd_egp"), F.col("cbe_lending_rate").alias("cbe_rate"))
    s = replace(trees.BOOSTED, trees=20, patience=5)
    bars = t.bars.filter(F.col("ticker").isin("S1", "S2", "S3", "S4", "S5"))
    short = bars.filter("ticker <> 'S5' OR dt < '1993-01-01'")  # too few samples
    report = models.run_experiment(short, macro, settings=s)
    rows = report.collect()
    assert 1 <= len(rows) <= 4 and "S5" not in {r.ticker for r in rows}
    for r in rows:
        assert r.samples >= 200 and r.endo_f1 >= 0.25 and 0 <= r.p_value <= 1
        assert r.significant == (r.p_value < 0.05 and r.dm_stat > 0 and r.f1_lift > 0)
        assert 1 <= r.endo_trees <= 20 and 1 <= r.exo_trees <= 20
    assert {"p_value", "train_pos_ratio", "exo_better", "auc_lift"} <= set(report.columns)
    strict = models.run_experiment(short, macro, settings=s, min_f1=2.0)
    assert strict.count() == 0


def test_keys_that_grow_side_by_side_have_the_trees_of_one():
    """One histogram for several keys, of different lengths and rounds, changes no tree; a key of one class has none."""
    rng, parts = np.random.default_rng(5), []
    for n in (60, 90, 35, 120, 50):
        x = rng.normal(size=(n + 20, 3)).round(1)
        y = (x[:, 0] + rng.normal(size=n + 20) > 0).astype(float)
        parts.append((x[:n], y[:n], x[n:], y[n:]))
    parts.insert(2, (parts[0][0], np.ones(60), parts[0][2], parts[0][3]))
    for s in (replace(trees.BOOSTED, trees=30, patience=5), replace(trees.HIST_BOOSTED, trees=30, patience=5, least=4, leaves=5)):
        together = trees.boost_many(parts, s)
        assert together == [trees.boost(*p, s) for p in parts] and together[2] is None
        assert len({m["n_tried"] for m in together if m}) > 1


def test_rows_of_a_key_stay_together():
    import pyarrow as pa

    keys = ["a"] * 5 + [None] * 3 + ["b"] * 4 + ["c"]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[i : i + 2], pa.string()), "v": list(range(i, min(i + 2, 13)))}) for i in range(0, 13, 2)]
    for most in (1, 2, 9):
        groups = list(trees._groups(iter(batches), "k", most))
        assert [t["k"].to_pylist() for g in groups for t in g] == [["a"] * 5, [None] * 3, ["b"] * 4, ["c"]]
        assert all(len(g) <= most for g in groups) and [v for g in groups for t in g for v in t["v"].to_pylist()] == list(range(13))


@pytest.mark.parametrize("cells, lines", [(1, 10**9), (200, 0), (1 << 20, 0)])
def test_histograms_in_blocks_give_the_same_trees(monkeypatch, cells, lines):
    """How many cells are worked on at a time and how they are added up changes no bit of a model; descent equals a walk from node to node."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 5)).round(1)
    y = (x[:, 0] + x[:, 3] > rng.normal(size=300)).astype(float)
    parts = [(x[i::4], y[i::4], x[:50], y[:50]) for i in range(3)]
    kinds = [(trees.boost_many, replace(trees.BOOSTED, trees=20)), (trees.boost_many, replace(trees.HIST_BOOSTED, trees=20, least=3)), (trees.forest_many, replace(trees.FOREST, trees=60))]
    before = [fit(parts, s) for fit, s in kinds]
    monkeypatch.setattr(trees, "CELLS", cells)
    monkeypatch.setattr(trees, "LINES", lines)
    assert [fit(parts, s) for fit, s in kinds] == before
    for m in (kind[0] for kind in before):
        for row, p in zip(x[:20], trees.predict(m, x[:20]), strict=True):
            total = []
            for node in m["roots"]:
                while m["feature"][node] >= 0:
                    node = m["child"][node] + int(row[m["feature"][node]] > m["at"][node])
                total.append(m["at"][node])
            assert p == pytest.approx(sum(total), abs=1e-12)
