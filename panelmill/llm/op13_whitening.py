"""Embedding whitening by an incremental eigendecomposition.

A spectrum is (number of vectors, mean, eigenvalues, eigenvectors) of a centred scatter matrix. Every partition starts from an empty
spectrum and applies centred rank-one updates; an update turns the spectrum of A into that of A + v v' by the roots of the secular
equation, after deflation: coordinates without weight keep their pair, equal eigenvalues are turned until one of them carries
the weight of all. The rows of a block are first turned by a QR factorisation into as many rows as there are dimensions, which have
the same scatter; each of them is one update, and the shift of the mean is one more. Spectra are combined in a tree on the
cluster, FAN at a time: the second one's pairs and the shift of the mean are rank-one updates of the first.

The merged basis is then refined over all rows: partitions sum the centred products of the rows seen in that basis, and the eigenvectors
of the small sum turn the basis (Rayleigh-Ritz), until what stands beside the diagonal is rounding only. Whitened rows are projections
divided by the root of the eigenvalue. Rows are written as integers floor(64 c) + 1000000, so that sums and deviations are exact.

Sizes: a spectrum has 8 d (d + 2) bytes for d dimensions, whatever the number of rows; the driver and the closures of the
tasks hold one.

Edge cases: rows whose vector is null or holds a null or non-finite component take no part. Shorter vectors are filled up with
zeros to the longest; where all are empty there are no components and no rows. Components beyond 2^62 / 64 count as that. A
component whose eigenvalue is rounding only (n = 1, constant or dependent dimensions) has null in `whitened`, and `identity_error` looks at the
others; without any it is null. `explained` is null where all rows are equal. A deviation that no long holds is null. Ties
among eigenvalues: any basis, the same for all rows. Repeated rows and null ids stay rows of their own. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.session import materialise

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 4_096  # rows that are turned into updates together
FAN = 16  # spectra that one task combines
ROWS = 2_048  # rows whose results make one batch
EPS = np.finfo(np.float64).eps
ORACLE_SQL = None  # eigenvectors are not SQL; tested against a dense solver

SPECTRUM = "slot long, n long, high array<long>, low array<long>, mean array<double>, values array<double>, basis array<double>"
MOMENTS = "slot long, n long, mean array<double>, products array<double>"


def integers(vector: Column) -> Column:
    """floor(64 c) + 1000000 of every component as a long; null where the vector takes no part."""
    bound = float(1 << 62)
    whole = F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-bound), F.least(F.lit(bound), c.cast("double") * SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.when(finite, whole)


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Roots of 1 + sum(w / (poles - x)), rising distinct poles and positive weights, as the matrix poles - roots: column k is seen from
    the pole nearest to root k, so that small distances keep their digits."""
    m = len(poles)
    total = weights.sum()
    if m == 1:
        return np.array([[-total]])
    right = np.append(poles[1:], poles[-1] + total)
    half = (right - poles) / 2
    apart = poles[:, None] - poles[None, :]
    middle = 1 + (weights[:, None] / (apart - half[None, :])).sum(axis=0)
    origin = np.where((middle >= 0) | (np.arange(m) == m - 1), np.arange(m), np.minimum(np.arange(m) + 1, m - 1))
    seen = poles[:, None] - poles[origin][None, :]  # poles as seen from each root's origin
    left_of, last = origin == np.arange(m), m - 1
    low = np.where(left_of, 0.0, -half)
    high = np.where(left_of, half, 0.0)
    high[last] = total
    x = (low + high) / 2
    below = np.tri(m, m, 0, dtype=bool).T  # [j, k]: pole j stands left of root k
    here, there = np.arange(m), np.minimum(np.arange(m) + 1, m - 1)
    for _ in range(80):
        gap = seen - x
        terms = weights[:, None] / gap
        f = 1 + terms.sum(axis=0)
        size = 1 + np.abs(terms).sum(axis=0)
        done = (np.abs(f) <= 2 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
        slopes = terms / gap
        before = np.where(below, slopes, 0).sum(axis=0)
        after = slopes.sum(axis=0) - before
        g, h = gap[here, here], gap[there, here]
        g[last], h[last] = gap[last - 1, last], gap[last, last]  # beyond the last pole the last two are interpolated
        after[last] = slopes[last, last]
        before[last] -= after[last]
        c = f - g * before - h * after
        c[last] = abs(c[last])
        a = (g + h) * f - g * h * (before + after)
        b = g * h * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.abs(a * a - 4 * b * c))
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
            step[last] = (a[last] + root[last]) / (2 * c[last]) if a[last] >= 0 else 2 * b[last] / (a[last] - root[last])
        fresh = x + step
        inside = np.isfinite(fresh) & (fresh > low) & (fresh < high)
        x = np.where(done, x, np.where(inside, fresh, (low + high) / 2))
    return seen - x


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising eigenvalues and the eigenvectors (columns) of basis diag(values) basis' + v v'."""
    z = v @ basis
    norm = z @ z
    if not norm > 0:
        return values, basis
    scale = max(values[-1], norm)
    small = 4 * EPS * scale
    active = np.abs(z) * np.sqrt(norm) > small
    if not active.any():
        return values, basis
    at = np.flatnonzero(active)
    near = np.flatnonzero(np.diff(values[at]) <= small)
    if len(near):
        basis, z = basis.copy(), z.copy()
        cuts = np.flatnonzero(np.diff(values[at]) > small) + 1
        for group in np.split(at, cuts):
            if len(group) > 1:  # a reflection puts the weight of equal eigenvalues on the last of them
                u = z[group].copy()
                length = np.linalg.norm(u)
                sign = 1.0 if u[-1] >= 0 else -1.0
                u[-1] += sign * length
                turned = basis[:, group]
                basis[:, group] = turned - np.outer(turned @ u, 2 * u / (u @ u))
                z[group] = 0
                z[group[-1]] = -sign * length
                active[group[:-1]] = False
        at = np.flatnonzero(active)
    poles, part = values[at], z[at]
    gaps = secular_roots(poles, part * part)  # [j, k] = pole j - root k
    apart = poles[:, None] - poles[None, :]
    m = len(at)
    if m > 1:  # weights of which the computed roots are exact (Loewner), so that the vectors stay orthogonal
        np.fill_diagonal(apart, 1.0)
        ratio = np.abs(gaps[:, : m - 1] / np.where(np.arange(m)[:, None] > np.arange(m - 1)[None, :], apart[:, : m - 1], apart[:, 1:]))
        weight = np.sqrt(np.prod(ratio, axis=1) * np.abs(gaps[:, m - 1])) * np.sign(part)
    else:
        weight = part
    vectors = weight[:, None] / gaps
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    fresh, wide = values.copy(), basis.copy()
    fresh[at] = poles - np.diagonal(gaps)
    wide[:, at] = basis[:, at] @ vectors
    order = np.argsort(fresh, kind="stable")
    return fresh[order], wide[:, order]


class Spectrum:
    """Number, mean, eigenvalues and eigenvectors of the centred scatter of the rows seen so far."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, basis: np.ndarray):
        self.n, self.mean, self.values, self.basis = n, mean, values, basis

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def update(self, v: np.ndarray) -> None:
        self.values, self.basis = rank_one(self.values, self.basis, v)

    def _shift(self, n: int, mean: np.ndarray) -> None:
        away, total = mean - self.mean, self.n + n
        if self.n:
            self.update(away * np.sqrt(self.n * n / total))
        self.mean, self.n = self.mean + away * (n / total), total

    def add(self, rows: np.ndarray) -> None:
        """Rows (as doubles) by one rank-one update each, a block of more rows than dimensions after a QR factorisation."""
        if not len(rows):
            return
        mean = rows.mean(axis=0)
        centred = rows - mean
        if len(centred) > centred.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        self._shift(len(rows), mean)
        for v in centred:
            self.update(v)

    def merge(self, other: Spectrum) -> None:
        self._shift(other.n, other.mean)
        for value, v in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.update(np.sqrt(value) * v)


def _matrix(column, d: int) -> np.ndarray:
    """Lists of longs as a matrix of d columns; shorter ones are filled up with the integer of zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(flat) == len(lists) * d:
        return flat.reshape(-1, d)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.full((len(lists), d), SHIFT, np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _row(schema: str, **columns) -> pa.RecordBatch:
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([columns[n]]) for n in names], names=names)


def _spectra(d: int, block: int):
    """(slot, x) in; one spectrum of all rows of the partition out, with the exact sums in two parts of 31 bits and the rest."""

    def run(batches):
        found, high, low, slot = Spectrum.empty(d), np.zeros(d, np.int64), np.zeros(d, np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x):
                continue
            slot = batch.column(0)[0].as_py()
            high += (x >> 31).sum(axis=0)
            low += (x & ((1 << 31) - 1)).sum(axis=0)
            for at in range(0, len(x), block):
                found.add((x[at : at + block] - SHIFT).astype(np.float64))
        if found.n:
            lists = {"high": high, "low": low, "mean": found.mean, "values": found.values, "basis": found.basis.ravel()}
            yield _row(SPECTRUM, slot=slot, n=found.n, **{k: v.tolist() for k, v in lists.items()})

    return run


def _merged_spectra(table: pa.Table) -> pa.Table:
    """Spectra of one slot in, combined in a fixed order; one out."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["mean"], r["values"], r["basis"]))
    parts = [Spectrum(r["n"], *(np.array(r[k]) for k in ("mean", "values")), np.array(r["basis"]).reshape(len(r["mean"]), -1)) for r in rows]
    whole = parts[0]
    for part in parts[1:]:
        whole.merge(part)
    sums = {k: np.sum([r[k] for r in rows], axis=0).tolist() for k in ("high", "low")}
    return pa.Table.from_batches([_row(SPECTRUM, slot=rows[0]["slot"], n=whole.n, **sums, mean=whole.mean.tolist(), values=whole.values.tolist(), basis=whole.basis.ravel().tolist())])


def _merged_moments(table: pa.Table) -> pa.Table:
    """(n, mean, centred products) of one slot in; those of all its rows together out."""
    n, mean, products, slot = 0, None, None, 0
    for r in sorted(table.to_pylist(), key=lambda r: (r["mean"], r["products"])):
        m, p, slot = np.array(r["mean"]), np.array(r["products"]), r["slot"]
        if not n:
            n, mean, products = r["n"], m, p
            continue
        away, total = m - mean, n + r["n"]
        products = products + p + np.outer(away, away).ravel() * (n * r["n"] / total)
        mean, n = mean + away * (r["n"] / total), total
    return pa.Table.from_batches([_row(MOMENTS, slot=slot, n=n, mean=mean.tolist(), products=products.tolist())])


def _tree(parts: DataFrame, merge, schema: str, fan: int, name: str):
    """The one row that is left when FAN rows of neighbouring slots become one, again and again; None without rows."""
    parts = materialise(parts, name)
    rows, top = parts.agg(F.count("*"), F.max("slot")).first()
    while rows > 1:
        parts = parts.withColumn("slot", F.floor(F.col("slot") / fan).cast("long")).groupBy("slot").applyInArrow(merge, schema)
        top //= fan
        if top:
            parts = materialise(parts, name)
            rows = parts.count()
        else:
            rows = 1
    return parts.first()


class Centre:
    """Exact sums as a whole number a dimension and a rest, so that rows are centred before anything is rounded."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = np.array([(s - n * b) / n for s, b in zip(sums, self.base, strict=True)])
        self.left = [s - n * b for s, b in zip(sums, self.base, strict=True)]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.base, np.int64)) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Per row the exact sum of (n x - sum)^2; null where no long holds it."""
        off = x - np.array(self.base, np.int64)
        most = max(1, int(np.abs(off).max(initial=0))) * self.n + self.n
        if most * most * max(1, x.shape[1]) < 1 << 62:
            y = off * self.n - np.array(self.left, np.int64)
            return pa.array((y * y).sum(axis=1))
        exact = [sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.left, strict=True)) for row in off]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _moments(rows: DataFrame, centre: Centre, turn: np.ndarray, fan: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and centred products (divisor n) over all rows of centred x times `turn`."""
    d, wide = turn.shape

    def run(batches):
        n, mean, products, slot = 0, np.zeros(wide), np.zeros((wide, wide)), 0
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x):
                continue
            slot = batch.column(0)[0].as_py()
            y = centre.centred(x) @ turn
            m, k = y.mean(axis=0), len(y)
            y = y - m
            away, total = m - mean, n + k
            products += y.T @ y + np.outer(away, away) * (n * k / total)
            mean, n = mean + away * (k / total), total
        if n:
            yield _row(MOMENTS, slot=slot, n=n, mean=mean.tolist(), products=products.ravel().tolist())

    row = _tree(rows.mapInArrow(run, MOMENTS), _merged_moments, MOMENTS, fan, name)
    return np.array(row.mean), np.array(row.products).reshape(wide, wide) / row.n


class Whitening:
    """What `fit` returns: the centre, the falling eigenvalues, the eigenvectors as columns, the trace."""

    def __init__(self, centre: Centre, values: np.ndarray, basis: np.ndarray):
        self.centre, self.values, self.basis, self.trace = centre, values, basis, float(values.sum())

    def turn(self, components: int) -> np.ndarray:
        """Columns that whiten; nan where an eigenvalue is rounding only."""
        values = self.values[:components]
        with np.errstate(all="ignore"):
            return self.basis[:, :components] / np.where(values > len(self.values) * EPS * max(self.values[0], 1e-300), np.sqrt(np.abs(values)), np.nan)


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = integers(F.col(vec_col))
    return vectors.select(F.col(id_col).alias("vec_id"), x.alias("x")).where("x IS NOT NULL")


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, fan: int = FAN, rounds: int = 4) -> Whitening | None:
    """The eigendecomposition of the covariance of all usable vectors; None without any component."""
    rows = _usable(vectors, id_col, vec_col).select(F.spark_partition_id().cast("long").alias("slot"), "x")
    d = rows.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return None
    first = _tree(rows.mapInArrow(_spectra(d, block), SPECTRUM), _merged_spectra, SPECTRUM, fan, "spectra")
    centre = Centre(first.n, [(h << 31) + low for h, low in zip(first.high, first.low, strict=True)])
    basis = np.array(first.basis).reshape(d, d)
    for _ in range(rounds):
        _, seen = _moments(rows, centre, basis, fan, "ritz")
        beside = np.abs(seen - np.diag(np.diagonal(seen))).max(initial=0)
        values, turned = np.linalg.eigh((seen + seen.T) / 2)
        basis, _ = np.linalg.qr(basis @ turned)
        if beside <= 64 * EPS * max(np.diagonal(seen).max(), 0):
            break
    return Whitening(centre, np.maximum(values[::-1], 0), basis[:, ::-1])


def whiten(vectors: DataFrame, model: Whitening | None, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding", fan: int = FAN) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    rows = _usable(vectors, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    turn = model.turn(components)
    d, wide = turn.shape
    good = ~np.isnan(turn).any(axis=0)
    error = None
    if good.any():
        slotted = rows.select(F.spark_partition_id().cast("long").alias("slot"), "x")
        _, covariance = _moments(slotted, model.centre, turn[:, good], fan, "identity")
        error = float(np.abs(covariance - np.eye(int(good.sum()))).max())
    explained = (model.values[:wide] / model.trace).tolist() if model.trace else [None] * wide
    centre = model.centre

    def run(batches):
        names = [x.split(" ")[0] for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), d)
                count = len(x) * wide
                each = pa.array(np.repeat(np.arange(len(x)), wide))
                y = (centre.centred(x) @ turn).ravel()
                cells = [
                    part.column(0).take(each),
                    pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(count, centre.n, np.int64)),
                    centre.deviations(x).take(each),
                    pa.array(y, mask=np.isnan(y)),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * count, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(cells, names=names)

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit(vectors))
