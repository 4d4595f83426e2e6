"""Tree ensembles per key: boosted trees stopped by patience, histogram boosting, random forests.

Spark deals the rows of a ticker to one partition, side by side; the calendar bounds a ticker, whatever the size of the panel. Boosting needs one
sum of gradients per level, thousands in a row, so a level is a histogram over (tree, node, feature, bin), and the trees of a round of some
tickers grow side by side in it. The trees of a forest do not wait for each other and share a histogram too.

A model is a row of flat arrays per key: `feature` (-1 for a leaf), `at` (threshold or leaf value), `child` (left child, the right
one follows it), `roots`. A value at or below the threshold goes left; nulls count as 0. Keys whose training rows have one class have no model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from panelmill.operators.panel import DATE, KEY


@dataclass(frozen=True)
class Settings:
    """One ensemble. `metric` of the staged validation score: f1 or logloss; `held` takes every n-th training row for it where there is no
    split of its own."""

    trees: int
    depth: int
    rate: float = 1.0
    l2: float = 0.0
    least: int = 1  # training rows of a leaf
    leaves: int = 0  # 0: as many as the depth allows
    even: bool = False  # one split for all nodes of a level
    bins: int = 64
    patience: int = 50
    metric: str = "f1"
    held: int = 0
    seed: int = 42


# Published settings of the learners.
BOOSTED = Settings(trees=1000, depth=6, rate=0.03, l2=3.0, even=True)
HIST_BOOSTED = Settings(trees=1000, depth=8, rate=0.05, least=20, leaves=31, metric="logloss", held=10)
FOREST = Settings(trees=500, depth=10, least=4, bins=32)

SIDE_BY_SIDE = 50  # trees of a forest that grow together
KEYS_AT_ONCE = 128  # keys of a partition whose boosting runs together
CELLS = 1 << 15  # of histograms that are worked on at a time: what a core holds near
LINES = 500  # from which on running sums go bin by bin
SCHEMA = "n_train long, n_trees int, n_tried int, best double, importance array<double>, feature array<int>, at array<double>, child array<int>, roots array<int>"


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds per column: middles between neighbouring distinct values, thinned to evenly filled bins."""
    out = []
    for column in x.T:
        values, counts = np.unique(column, return_counts=True)
        cuts = (values[1:] + values[:-1]) / 2
        if len(values) > bins:
            below = np.cumsum(counts)[:-1]
            wanted = np.arange(1, bins) * (len(column) / bins)
            cuts = cuts[np.unique(np.minimum(np.searchsorted(below, wanted), len(cuts) - 1))]
        out.append(cuts)
    return out


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)


class Trees(NamedTuple):
    """Trees that grew together, their nodes level by level; thresholds are bins until the ensemble is done. `gain` by tree and feature."""

    owner: np.ndarray
    feature: np.ndarray
    at: np.ndarray
    child: np.ndarray
    gain: np.ndarray


def gains(codes: np.ndarray, rows: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, picked: np.ndarray | None, own_g, own_h, own_n, s: Settings, bins: int) -> np.ndarray:
    """(nodes, features tried times bins): G^2 / (H + l2) of both sides less that of the node, by the last bin that goes left; 0 where a side has too few entries."""
    u, k = len(own_n), codes.shape[1] if picked is None else picked.shape[1]
    lines = u * k
    cell = codes[rows] if picked is None else codes.ravel().take((rows * codes.shape[1])[:, None] + picked.take(node, axis=0))
    cell *= lines
    cell += np.arange(k)
    cell += (node * k)[:, None]
    cell = cell.ravel()
    left_g, left_h, left_n = (np.bincount(cell, w, bins * lines).reshape(bins, lines) for w in (np.repeat(g, k), np.repeat(h, k), None))
    for x in (left_g, left_h, left_n):
        if lines < LINES:
            np.cumsum(x, axis=0, out=x)
        else:  # the same sums; faster on long rows
            for before, after in zip(x[:-1], x[1:], strict=True):
                after += before
    own_g, own_h, own_n = (np.repeat(x, k) for x in (own_g, own_h, own_n))
    with np.errstate(all="ignore"):
        gain, right, below = left_g, own_g - left_g, own_h - left_h
        for square, weight in ((gain, left_h), (right, below)):
            if s.l2:
                weight += s.l2
            np.square(square, out=square)
            square /= weight
        gain += right
        gain -= own_g**2 / (own_h + s.l2)
    # the bits of a gain stay where neither number of entries is below the least: without branches
    few = (own_n - s.least) - left_n
    left_n -= s.least
    few |= left_n
    few >>= 63
    np.invert(few, out=few)
    gain.view(np.int64)[:] &= few
    return np.ascontiguousarray(gain.T).reshape(u, -1)


def grow(codes: np.ndarray, rows: np.ndarray, tree: np.ndarray, count: int, g: np.ndarray, h: np.ndarray, s: Settings, bins: int, tried: int = 0, rng=None) -> tuple[Trees, np.ndarray]:
    """Grows `count` trees level by level from entries (row, tree, gradient, hessian); (trees, leaf of each entry). The roots are the first nodes.

    `tried` features per node are looked at (0: all). A split is the largest gain of G^2 / (H + l2), the first of equals. Nodes with too few
    entries for two leaves get no histogram.
    """
    features, slot, leaf = codes.shape[1], tree, tree.copy()
    first, owner = 0, np.arange(count)
    live = np.arange(len(rows))  # entries in open nodes, those of a node together and in their order
    leaves, gained, levels = np.ones(count, int), np.zeros((count, features)), []
    for level in range(s.depth + 1):
        m = len(owner)
        live_g, live_h = g[live], h[live]
        sum_g, sum_h = (np.bincount(slot, x, m) for x in (live_g, live_h))
        values = np.divide(-sum_g, sum_h + s.l2, out=np.zeros(m), where=sum_h + s.l2 > 0)
        split_at, child = np.full(m, -1), np.zeros(m, int)
        levels.append((owner, split_at, values, child))
        if level == s.depth or not len(live):
            break
        drawn = rng.random((m, features)) if tried else None
        n = np.bincount(slot, minlength=m)
        used = np.flatnonzero(n >= 2 * s.least)
        if not len(used):
            break
        row, cell_of, u = rows[live], slot, len(used)
        if u < m:
            place = np.full(m, -1)
            place[used] = np.arange(u)
            cell_of = place[slot]
            inside = cell_of >= 0
            row, cell_of, live_g, live_h = row[inside], cell_of[inside], live_g[inside], live_h[inside]
            own = sum_g[used], sum_h[used], n[used]
        else:
            own = sum_g, sum_h, n
        picked, whose = np.sort(np.argpartition(drawn[used], tried - 1, axis=1)[:, :tried], axis=1) if tried else None, owner[used]
        width = (tried or features) * bins
        starts = np.searchsorted(whose, np.arange(count + 1)) if s.even else np.arange(u + 1)
        blocks, most = [0], max(1, CELLS // width)
        while blocks[-1] < u:  # some nodes at a time, whole trees where they split as one
            blocks.append(int(starts[max(np.searchsorted(starts, blocks[-1] + most, "right") - 1, np.searchsorted(starts, blocks[-1], "right"))]))
        ends, best, top = np.searchsorted(cell_of, blocks), np.zeros(count if s.even else u, int), np.zeros(u)
        whole = np.zeros(count)
        for i, (one, end) in enumerate(zip(blocks[:-1], blocks[1:], strict=True)):
            here = slice(ends[i], ends[i + 1])
            some = None if picked is None else picked[one:end]
            gain = gains(codes, row[here], cell_of[here] - one, live_g[here], live_h[here], some, *(x[one:end] for x in own), s, bins)
            if s.even:
                for t in range(whose[one], whose[end - 1] + 1):
                    if starts[t] < starts[t + 1]:
                        mine = gain[starts[t] - one : starts[t + 1] - one]
                        total = mine.sum(axis=0)
                        best[t] = total.argmax()
                        whole[t] = total[best[t]]
                        top[starts[t] : starts[t + 1]] = mine[:, best[t]]
            else:
                best[one:end] = gain.argmax(axis=1)
                top[one:end] = gain[np.arange(end - one), best[one:end]]
        if s.even:  # one split for all nodes of a tree, also those without a histogram
            split = (whole > 1e-12)[owner]
            np.add.at(gained, (whose, best[whose] // bins), np.where(split[used], top, 0.0))
            at, best = np.flatnonzero(split), best[owner]
            cut, chosen = best[at] % bins, best[at] // bins
        else:
            split = top > 1e-12
            if s.leaves:  # the best splits of a tree's level first
                order = np.flatnonzero(split)
                order = order[np.lexsort((-top[order], owner[used[order]]))]
                whose = owner[used[order]]
                rank = np.arange(len(order)) - np.searchsorted(whose, whose, side="left")
                split[order[leaves[whose] + rank >= s.leaves]] = False
                leaves += np.bincount(owner[used[split]], minlength=count)
            hit = np.flatnonzero(split)
            at, cut = used[hit], best[hit] % bins
            chosen = best[hit] // bins if picked is None else picked[hit, best[hit] // bins]
            np.add.at(gained, (owner[at], chosen), top[hit])
        if not len(at):
            break
        split_at[at], values[at], child[at] = chosen, cut, first + m + 2 * np.arange(len(at))
        number = np.full(m, -1)
        number[at] = np.arange(len(at))
        stays = number[slot] >= 0
        live, slot = live[stays], slot[stays]
        right = codes[rows[live], split_at[slot]] > values[slot]
        slot = 2 * number[slot] + right
        together = np.argsort(slot.astype(np.int16) if 2 * len(at) < 1 << 15 else slot, kind="stable")
        live, slot = live[together], slot[together]
        first += m
        leaf[live] = first + slot
        owner = np.repeat(owner[at], 2)
    return Trees(*(np.concatenate(x) for x in zip(*levels, strict=True)), gained), leaf


def descend(x: np.ndarray, roots: np.ndarray, feature: np.ndarray, at: np.ndarray, child: np.ndarray, alone: bool = False) -> np.ndarray:
    """(rows, trees) leaf numbers; with `alone` each row has one root of its own."""
    features, trees = x.shape[1], 1 if alone else len(roots)
    node = roots.copy() if alone else np.tile(roots, len(x))
    place, values = np.arange(len(node)), np.ascontiguousarray(x).ravel()
    line = place // trees * features  # where the row of a place begins
    while True:
        here = node[place]
        f = feature[here]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node if alone else node.reshape(len(x), trees)
        if len(inner) < len(place):
            place, line, here, f = place[inner], line[inner], here[inner], f[inner]
        node[place] = child[here] + (values[line + f] > at[here])


def balanced(y: np.ndarray) -> np.ndarray:
    ones = y.sum()
    return np.where(y == 1, len(y) / (2 * ones), len(y) / (2 * (len(y) - ones)))


def validation_score(metric: str, y: np.ndarray, score: np.ndarray, w: np.ndarray) -> float:
    """Larger is better: weighted F1 at 0.5, or the negative weighted log loss."""
    if metric == "logloss":
        return -float(np.sum(w * (np.logaddexp(0, score) - y * score)) / np.sum(w))
    hit = score > 0
    right = np.sum(w[hit & (y == 1)])
    missed = np.sum(w[hit != (y == 1)])
    return float(2 * right / (2 * right + missed)) if right else 0.0


def best_prefix(scores: list[float], patience: int) -> tuple[int, bool]:
    """(number of trees up to the first best score, whether `patience` further ones have not been better)."""
    best = int(np.argmax(scores))
    return best + 1, len(scores) - best > patience


@dataclass
class Fit:
    """One key's share of a boosting run."""

    place: int
    edges: list[np.ndarray]
    size: int
    scores: list[float]
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # (feature, at, child, gain) of a tree


def boost(x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray, s: Settings) -> dict | None:
    """Boosted trees from score 0 with Newton leaves; the best prefix by validation score stays. All trees stay without validation rows."""
    return boost_many([(x, y, x_val, y_val)], s)[0]


def boost_many(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], s: Settings) -> list[dict | None]:
    """`boost` of several keys, whose trees of a round grow side by side in one histogram; a key that stops leaves it."""
    out, fits, held, held_val = [None] * len(parts), [], [], []
    for place, (x, y, x_val, y_val) in enumerate(parts):
        if not len(y) or y.min() == y.max():
            continue
        if s.held and not len(y_val):
            aside = np.arange(len(y)) % s.held == s.held - 1
            if aside.any() and 0 < y[~aside].sum() < (~aside).sum():
                x, y, x_val, y_val = x[~aside], y[~aside], x[aside], y[aside]
        edges = bin_edges(x, s.bins)
        w = balanced(y)
        each = {c: w[y == c][0] for c in (0, 1)}
        held.append((coded(x, edges), y, w, np.full(len(y), len(fits)), np.zeros(len(y))))
        held_val.append((coded(x_val, edges), y_val, np.where(y_val == 1, each[1], each[0]), np.full(len(y_val), len(fits)), np.zeros(len(y_val))))
        fits.append(Fit(place, edges, len(y), [], []))
    if not fits:
        return out
    bins = max(2, *(len(e) + 1 for f in fits for e in f.edges))
    codes, y, w, own, score = (np.concatenate(c) for c in zip(*held, strict=True))
    codes_val, y_val, w_val, own_val, score_val = (np.concatenate(c) for c in zip(*held_val, strict=True))
    for left in range(s.trees, 0, -1):
        count, p = len(fits), 1 / (1 + np.exp(-score))
        grown, leaf = grow(codes, np.arange(len(y)), own, count, w * (p - y), w * p * (1 - p), s, bins)
        score += s.rate * grown.at[leaf]
        order = np.argsort(grown.owner, kind="stable")  # a tree's nodes in their order
        ends = np.cumsum(np.bincount(grown.owner, minlength=count))
        number = np.empty(len(order), int)
        number[order] = np.arange(len(order))
        feature, at, child = grown.feature[order], grown.at[order], number[grown.child[order]]
        if len(y_val):
            node = descend(codes_val, own_val, grown.feature, grown.at, grown.child, alone=True)
            score_val += s.rate * grown.at[node]
        starts = np.searchsorted(own_val, np.arange(count + 1))
        stopped = np.zeros(count, bool)
        for i, f in enumerate(fits):
            first, end = (ends[i - 1] if i else 0), ends[i]
            f.grown.append((feature[first:end], at[first:end], np.where(feature[first:end] >= 0, child[first:end] - first, 0), grown.gain[i]))
            if starts[i] < starts[i + 1]:
                mine = slice(starts[i], starts[i + 1])
                f.scores.append(validation_score(s.metric, y_val[mine], score_val[mine], w_val[mine]))
                stopped[i] = best_prefix(f.scores, s.patience)[1]
            if stopped[i] or left == 1:
                used = best_prefix(f.scores, s.patience)[0] if f.scores else len(f.grown)
                out[f.place] = model(f.grown[:used], f.edges, s.rate, f.size, len(f.grown), max(f.scores, default=None))
        if stopped.any():
            fits = [f for f, gone in zip(fits, stopped, strict=True) if not gone]
            if not fits:
                break
            stay, stay_val, renumbered = ~stopped[own], ~stopped[own_val], np.cumsum(~stopped) - 1
            codes, y, w, own, score = codes[stay], y[stay], w[stay], renumbered[own[stay]], score[stay]
            codes_val, y_val, w_val, own_val, score_val = codes_val[stay_val], y_val[stay_val], w_val[stay_val], renumbered[own_val[stay_val]], score_val[stay_val]
    return out


def forest(x: np.ndarray, y: np.ndarray, x_val: np.ndarray, y_val: np.ndarray, s: Settings) -> dict | None:
    """Trees on bootstrap samples, the square root of the features tried per node; leaves hold the weighted share of ones."""
    if not len(y) or y.min() == y.max():
        return None
    edges = bin_edges(x, s.bins)
    bins = max(2, max(map(len, edges)) + 1)
    codes, w, n = coded(x, edges), balanced(y), len(y)
    rng, grown = np.random.default_rng([s.seed, n]), []
    for first in range(0, s.trees, SIDE_BY_SIDE):
        count = min(SIDE_BY_SIDE, s.trees - first)
        drawn = rng.integers(0, n, (count, n)) + n * np.arange(count)[:, None]
        cells, times = np.unique(drawn, return_counts=True)
        rows, weight = cells % n, times * w[cells % n]
        trees = grow(codes, rows, cells // n, count, -weight * y[rows], weight, s, bins, max(1, int(x.shape[1] ** 0.5)), rng)[0]
        grown.append((trees.feature, trees.at, trees.child, trees.gain.sum(axis=0), count))
    return model(grown, edges, 1 / s.trees, n, s.trees, None)


def forest_many(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], s: Settings) -> list[dict | None]:
    """`forest` of several keys; the trees of one key are many enough to grow side by side."""
    return [forest(*part, s) for part in parts]


def model(grown: list[tuple], edges: list[np.ndarray], scale: float, n: int, tried: int, best: float | None) -> dict:
    """The flat row of an ensemble from (feature, at, child, gain, number of its trees or nothing for one): bins become thresholds, leaf values are scaled."""
    sizes = [len(g[0]) for g in grown]
    firsts = np.cumsum([0, *sizes[:-1]])
    feature, at = (np.concatenate([g[i] for g in grown]) for i in (0, 1))
    child = np.concatenate([g[2] for g in grown]) + np.repeat(firsts, sizes)
    roots = np.concatenate([first + np.arange(g[4] if len(g) > 4 else 1) for first, g in zip(firsts, grown, strict=True)])
    flat, starts = np.concatenate(edges), np.cumsum([0, *map(len, edges)])
    inner = feature >= 0
    values = at * scale
    values[inner] = flat[starts[feature[inner]] + at[inner].astype(int)]
    gain = np.zeros(len(edges))
    for g in grown:
        gain += g[3]
    total = gain.sum()
    importance = (gain / total if total > 0 else gain).tolist()
    arrays = {"feature": feature.tolist(), "at": values.tolist(), "child": child.tolist(), "roots": roots.tolist()}
    return {"n_train": n, "n_trees": len(roots), "n_tried": tried, "best": best, "importance": importance, **arrays}


def predict(m: dict, x: np.ndarray) -> np.ndarray:
    """Sum of the leaf values of all trees."""
    at = np.array(m["at"])
    return at[descend(x, np.array(m["roots"]), np.array(m["feature"]), at, np.array(m["child"]))].sum(axis=1)


# ------------------------------------------------------------------------------ Spark


def _arrays(table: pa.Table, features: list[str], target: str):
    """Feature matrix, target and split of a group, in a fixed order of its rows."""
    x = np.stack([table[f].to_numpy() for f in features], axis=1) if features else np.zeros((table.num_rows, 0))
    y, split = table[target].to_numpy().astype(float), np.array(table["_split"].to_pylist(), dtype=object)
    order = np.lexsort((*x.T[::-1], y, table["_order"].to_numpy()))
    return x[order], y[order], split[order], order


def spread(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows dealt by key over one partition more than shuffles have: adaptive execution joins small ones, but a fit is much work per
    byte. With the same number an earlier exchange by the key would be taken instead, and that one is joined."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, key)


def _staged(df: DataFrame, features: list[str], target: str, key: str, order: str) -> DataFrame:
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    place = F.coalesce(F.unix_date(F.col(order).cast("date")), F.lit(0)).alias("_order")
    return df.select(key, *numbers, F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias(target), F.col("split").alias("_split"), place)


def _ends(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the next key begins."""
    ids = [table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
    return np.flatnonzero(np.any([np.diff(i) for i in ids], axis=0)) + 1


def _groups(batches: Iterator[pa.RecordBatch], key: str | list[str], most: int = KEYS_AT_ONCE) -> Iterator[list[pa.Table]]:
    """The rows of up to `most` keys at a time, a table each, from batches whose equal keys (nulls too) lie together."""
    keys = [key] if isinstance(key, str) else key
    held = None  # the last key may go on in the next batch
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        ends = _ends(held, keys)
        while len(ends) >= most:
            yield [held.slice(a, b - a) for a, b in zip((0, *ends[: most - 1]), ends[:most], strict=True)]
            held, ends = held.slice(ends[most - 1]), ends[most:] - ends[most - 1]
    if held is not None and held.num_rows:
        ends = [*_ends(held, keys), held.num_rows]
        yield [held.slice(a, b - a) for a, b in zip((0, *ends[:-1]), ends, strict=True)]


def _fit_per_key(fit, df: DataFrame, features: list[str], target: str, key: str, order: str, s: Settings) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches):
        for tables in _groups(batches, key):
            parts = []
            for table in tables:
                x, y, split, _ = _arrays(table, features, target)
                train, val = split == "train", split == "val"
                parts.append((x[train], y[train], x[val], y[val]))
            rows = [{key: table[key][0].as_py(), **m} for table, m in zip(tables, fit(parts, s), strict=True) if m is not None]
            for row in rows:  # an ensemble can be large
                yield from pa.Table.from_pylist([row], schema=out).to_batches()

    schema = f"`{key}` {kind}, {SCHEMA}"
    out = _arrow(df.sparkSession, schema)
    rows = _staged(df.filter(F.col("split").isin("train", "val") & F.col(target).isNotNull()), features, target, key, order)
    return spread(rows, key).sortWithinPartitions(key).mapInArrow(run, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def fit_boosted_per_key(df: DataFrame, features: list[str], target: str, key: str = KEY, order: str = DATE, settings: Settings = BOOSTED) -> DataFrame:
    """One boosted ensemble per key from the rows with split train; the rows with split val stop it and choose its best prefix."""
    return _fit_per_key(boost_many, df, features, target, key, order, settings)


def fit_hist_boosted_per_key(df: DataFrame, features: list[str], target: str, key: str = KEY, order: str = DATE, settings: Settings = HIST_BOOSTED) -> DataFrame:
    """One histogram-boosted ensemble per key from the rows with split train, of which every tenth is held back to stop it."""
    return _fit_per_key(boost_many, df.filter("split = 'train'"), features, target, key, order, settings)


def fit_forest_per_key(df: DataFrame, features: list[str], target: str, key: str = KEY, order: str = DATE, settings: Settings = FOREST) -> DataFrame:
    """One random forest per key from the rows with split train."""
    return _fit_per_key(forest_many, df.filter("split = 'train'"), features, target, key, order, settings)


def score_per_key(df: DataFrame, models: DataFrame, features: list[str], key: str = KEY, out: str = "p", shares: bool = False) -> DataFrame:
    """`df` with the probability of each row by its key's model (log odds, or shares for forests); rows of keys without a model go."""
    fields = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes)}, `{out}` double"
    names = [n for n, _ in df.dtypes]

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not (rows.num_rows and found.num_rows):
            return pa.Table.from_pylist([], schema=arrow)
        x = np.stack([rows[f"_x{i}"].to_numpy() for i in range(len(features))], axis=1)
        total = predict({c: found[c][0].values.to_numpy(zero_copy_only=False) for c in ("feature", "at", "child", "roots")}, x)
        p = total if shares else 1 / (1 + np.exp(-total))
        return rows.select(names).append_column(out, pa.array(p)).cast(arrow)

    arrow = _arrow(df.sparkSession, fields)
    staged = df.select("*", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, f in enumerate(features)])
    return staged.groupBy(key).cogroup(models.groupBy(key)).applyInArrow(run, fields)


def importance_per_key(models: DataFrame, features: list[str], key: str = KEY) -> DataFrame:
    """(key, feature, importance): each feature's share of the gain of all splits."""
    names = F.array(*[F.lit(f) for f in features])
    cells = F.arrays_zip(names.alias("feature"), F.col("importance").alias("importance"))
    return models.select(key, F.explode(cells).alias("x")).select(key, F.col("x.feature").alias("feature"), F.col("x.importance").alias("importance"))


def fit_nested_sets(
    df: DataFrame, sets: dict[str, list[str]], target: str, key: str = KEY, order: str = DATE, settings: Settings = BOOSTED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Two or more feature sets fitted on the same rows of a key in one group: (key, order, split, target, keep, p_<set>, trees_<set>).

    One group and one order of rows serve all sets, so that losses compare row by row. Keys with one class go.
    """
    columns = sorted({f for fs in sets.values() for f in fs})
    kinds = dict(df.dtypes)
    fields = [key, order, "split", target, *keep]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in fields) + "".join(f", `p_{n}` double, `trees_{n}` int" for n in sets)
    place = {f: i for i, f in enumerate(columns)}

    def run(batches):
        for tables in _groups(batches, key):
            parts = [_arrays(table, [f"_x{i}" for i in range(len(columns))], "_y") for table in tables]
            found = {}
            for name, features in sets.items():
                own = [place[f] for f in features]
                found[name] = boost_many([(x[split == "train"][:, own], y[split == "train"], x[split == "val"][:, own], y[split == "val"]) for x, y, split, _ in parts], settings)
            for i, (table, (x, y, _, at)) in enumerate(zip(tables, parts, strict=True)):
                if any(found[name][i] is None for name in sets):
                    continue
                rows = table.take(pa.array(at)).select(fields)
                for name, features in sets.items():
                    m = found[name][i]
                    rows = rows.append_column(f"p_{name}", pa.array(1 / (1 + np.exp(-predict(m, x[:, [place[f] for f in features]])))))
                    rows = rows.append_column(f"trees_{name}", pa.array(np.full(len(y), m["n_trees"], np.int32)))
                yield from rows.cast(arrow).to_batches()

    arrow = _arrow(df.sparkSession, schema)
    numbers = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_x{i}") for f, i in place.items()]
    staged = df.filter(F.col(target).isNotNull()).select(
        *fields, *numbers, F.col(target).cast("double").alias("_y"), F.col("split").alias("_split"), F.coalesce(F.unix_date(F.col(order).cast("date")), F.lit(0)).alias("_order")
    )
    # the window brings the rows of a key together, without an exchange where they already are
    together = staged.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(key)))
    return together.sortWithinPartitions(key).mapInArrow(run, schema)
