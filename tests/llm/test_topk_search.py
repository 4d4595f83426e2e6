import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import op2_topk_search as op
from tests.oracle import compare, connect


def brute(rows, k=op.K):
    """Every row against every other row, in Python integers."""
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(vectors):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for other, (i, w) in enumerate(vectors) if other != at)
            out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_query_against_twin(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), folder, "op2", op.query, op.ORACLE_SQL)[0] == "ok"


@pytest.mark.parametrize("values,block", [(1 << 20, 4096), (500, 3)])
def test_edge_rows_and_ties(spark, values, block):
    rng = random.Random(4)
    some = [[rng.gauss(0, 0.3) for _ in range(12)] for _ in range(60)]
    rows = [(i, some[i % 60] if i % 3 else some[0]) for i in range(400)]
    rows += [(1000, None), (1050, [0.1, None]), (1100, [float("nan")] * 12), (1150, [float("inf")] * 12), (None, some[1]), (50, some[2]), (1200, some[3][:5]), (1250, []), (-50, some[4])]
    rows += [(100, some[7]), (100, some[7]), (150, [0.0] * 12)]  # repeated ids: every row asks and answers
    rows += [(1300, [7e4] + some[5][1:]), (1301, [-9e5] + some[5][1:]), (1350, [3e37, 1.5e9] + some[6][2:]), (1351, [3e37, 1.4e9] + some[6][2:]), (1352, [-3e37] + some[6][1:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, SCORE int")
    exact = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in df.collect()]
    got = op.search(df, F.col("vec_id") % 50 == 0, values=values, block=block)
    assert sorted(map(tuple, got.collect())) == brute(exact)
    assert op.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    assert len(op.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()) == 2


def test_index_stops_early():
    """20,000 vectors, half of them noisy copies of others: at most half of the segments are processed, and the answers are exact."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 64))
    vectors[10_000:] = vectors[:10_000] + rng.normal(0, 0.3, (10_000, 64))
    vectors = np.floor(256 * vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    index, asked = op.ImpactIndex(vectors), np.arange(0, 20_000, 400)
    found = index.top(vectors[asked], [np.array([i]) for i in asked], 5, np.full(len(asked), -np.inf))
    for i, (rows, scores) in zip(asked, found, strict=True):
        full = vectors @ vectors[i]
        full[i] = -np.inf
        assert (scores == full[rows]).all()
        assert rows[np.lexsort((rows, -scores))[:5]].tolist() == np.lexsort((np.arange(len(full)), -full))[:5].tolist()
    assert index.read <= 0.5 * index.held
    assert sum(len(rows) for rows, _ in found) < len(asked) * 20_000 / 16
