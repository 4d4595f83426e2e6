"""Whitening against a dense solver, and the updates of a spectrum by themselves."""

import math

import numpy as np
import pytest

from panelmill.llm import op13_whitening as op

KIND = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """{vec_id: deviation}, x - mean by vec_id, eigenvalues falling, eigenvectors; all from exact integers and a dense solver."""
    used = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in used]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    centred = np.array([[c / n for c in v] for v in off])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in used], [sum(c * c for c in v) for v in off], centred, values[::-1], vectors[:, ::-1]


def check(got, rows, components=32):
    ids, deviations, centred, values, vectors = plain(rows)
    wide = min(components, centred.shape[1])
    assert sorted({r.vec_id for r in got}) == sorted(set(ids)) and len(got) == len(ids) * wide
    table = {(r.vec_id, r.component): r for r in got}
    white = centred @ vectors[:, :wide] / np.sqrt(values[:wide])
    for k in range(wide):
        found = np.array([table[i, k + 1].whitened for i in ids])
        sign = 1 if found @ white[:, k] >= 0 else -1
        assert np.abs(found * sign - white[:, k]).max() < 1e-7
        assert table[ids[0], k + 1].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
    assert all(table[i, 1].deviation == d and table[i, 1].n == len(ids) for i, d in zip(ids, deviations, strict=True))
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_table_against_dense_solver(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(op.query(spark, folder).collect(), rows)


def test_many_partitions_and_a_hot_vector(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=7) * (1, 2, 3, 4, 5, 6, 0.3)]) for i in range(400)]
    rows += [(1_000 + i, rows[0][1]) for i in range(200)]
    rows += [(-1, None), (-2, [1.0, None, 0, 0, 0, 0, 0]), (-3, [math.inf] * 7), (-4, [math.nan] * 7)]
    df = spark.createDataFrame([(i, v and [None if c is None else float(c) for c in v], 0) for i, v in rows], KIND).repartition(37)
    model = op.fit(df, block=16, fan=3)
    check(op.whiten(df, model, components=4, fan=3).collect(), rows, 4)


@pytest.mark.parametrize(("n", "d", "block"), [(60, 12, 1), (60, 12, 7), (60, 12, 50), (5, 9, 64), (40, 1, 8)])
def test_spectrum_against_dense_solver(n, d, block):
    rng = np.random.default_rng(n + d + block)
    x = np.floor(rng.normal(size=(n, d)) * 20)
    x[n // 2 :: 3] = x[0]
    first, second = op.Spectrum.empty(d), op.Spectrum.empty(d)
    for at in range(0, n, block):
        (first if at < n // 2 else second).add(x[at : at + block])
    first.merge(second)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert first.n == n and np.allclose(first.mean, x.mean(axis=0))
    assert np.abs(first.basis * first.values @ first.basis.T - scatter).max() < 1e-9 * np.abs(scatter).max()
    assert np.abs(first.basis.T @ first.basis - np.eye(d)).max() < 1e-12


def test_close_and_equal_eigenvalues():
    """Deflation: the vectors stay orthogonal where eigenvalues agree in most or all digits."""
    rng = np.random.default_rng(0)
    values = np.sort(np.array([0, 0, 0, 1, 1 + 1e-15, 1 + 1e-13, 1 + 1e-9, 2, 2, 5.0]))
    basis, dense = np.linalg.qr(rng.normal(size=(10, 10)))[0], None
    dense = basis * values @ basis.T
    for scale in (1.0, 1e-9, 1e6, 0.0):
        v = rng.normal(size=10) * scale
        v = v - basis[:, 4] * (basis[:, 4] @ v)
        values, basis = op.rank_one(values, basis, v)
        dense = dense + np.outer(v, v)
        assert np.abs(basis * values @ basis.T - dense).max() < 1e-12 * max(1, np.abs(dense).max())
        assert np.abs(basis.T @ basis - np.eye(10)).max() < 1e-13
        assert (np.diff(values) >= 0).all()


def test_degenerate_tables(spark):
    def run(rows):
        df = spark.createDataFrame(rows, KIND)
        return op.whiten(df, op.fit(df)).collect()

    assert run([]) == [] and run([(1, None, 0), (2, [math.nan], 0)]) == [] and run([(1, [], 0)]) == []
    one = run([(1, [0.5, 0.25], 0)])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(k, 1, 0, None, None, None) for k in (1, 2)]
    line = run([(i, [float(i), 2.0 * i], 0) for i in range(5)])  # the second component has no variance
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-12
    ragged = run([(None, [1.0], 0), (7, [], 0), (7, [0.0, 1.0], 0), (7, [0.0, 1.0], 0)])
    assert len(ragged) == 8 and sum(r.vec_id is None for r in ragged) == 2
    assert sum(abs(r.whitened) for r in ragged) > 0
    large = run([(i, [1e30 * (i % 2), float(i)], 0) for i in range(4)])
    assert {r.deviation for r in large} == {None} and all(r.n == 4 for r in large)


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], i, i, i) for i in range(9)], "vec_id long, embedding array<double>, slot int, x int, n int")
    check(op.whiten(df, op.fit(df)).collect(), [(i, [float(i), float(i * i % 7)]) for i in range(9)])
