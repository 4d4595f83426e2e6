"""Mixing: targets by a plain rule, exact quotas, disjoint draws, equal reruns, the draw's distribution."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.llm import op11_mixing as op

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights, share=1.5, passes=2):
    """Shares by weight; what lies above a cap goes to those below, by weight, until nothing is above."""
    out = [share * sum(sizes) * w / sum(weights) for w in weights]
    for _ in range(10_000):
        excess = sum(max(0, t - passes * s) for t, s in zip(out, sizes, strict=True))
        out = [min(t, passes * s) for t, s in zip(out, sizes, strict=True)]
        below = [i for i, (t, s) in enumerate(zip(out, sizes, strict=True)) if t < passes * s]
        if excess < 1e-9 or not below:
            break
        whole = sum(weights[i] for i in below)
        for i in below:
            out[i] += excess * weights[i] / whole
    return out


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 3], [5, 0, 7, 900, 2, 40, 41], [0, 0], [7], [100, 100, 100, 1, 1, 1, 1000]])
def test_targets_against_plain_rule(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    assert op.targets(sizes, weights) == pytest.approx(plain_targets(sizes, weights), abs=1e-6)


def test_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        for key in (1, 2):
            assert sorted(op.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert op.permuted(np.arange(1000), 1000, 1).tolist() != op.permuted(np.arange(1000), 1000, 2).tolist()
    fixed = op.permuted(np.arange(10_000), 10_000, 5)
    assert abs(np.corrcoef(np.arange(10_000), fixed)[0, 1]) < 0.05


def test_draw_against_all_outcomes():
    from math import comb

    good, bad, taken, rounds = 5, 9, 6, 6000
    rng = np.random.default_rng(1)
    seen = Counter(op.hypergeometric(good, bad, taken, rng) for _ in range(rounds))
    for k in range(6):
        want = comb(good, k) * comb(bad, taken - k) / comb(good + bad, taken)
        assert abs(seen[k] / rounds - want) < 4 * (want / rounds) ** 0.5 + 1e-3
    large = [op.hypergeometric(4 * 10**10, 6 * 10**10, 10**10, rng) for _ in range(50)]
    assert abs(np.mean(large) / 4e9 - 1) < 1e-4 and len(set(large)) > 40
    assert op.hypergeometric(0, 5, 3, rng) == 0 and op.hypergeometric(5, 0, 3, rng) == 3 and op.hypergeometric(4, 4, 8, rng) == 4


def test_tree_keeps_quotas():
    quotas = [1000, 0, 37, 5, 1]
    table = op.split(quotas, 13)
    assert table.sum(axis=0).tolist() == quotas and (table >= 0).all()
    held = table.sum(axis=1)
    assert held.max() - held.min() <= 1
    assert (op.split(quotas, 13) == table).all() and (op.split(quotas, 13, 7) != table).any()


def check(rows, mixed, passes=2):
    """Everything that must hold of a mix, from its rows."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    names = sorted(sizes, key=lambda s: (s is None, s))
    wanted = dict(zip(names, plain_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((d, s, len((t or "").encode().split())) for d, t, s in rows)
    taken, places, draws, spans = defaultdict(int), defaultdict(set), defaultdict(set), Counter()
    for r in mixed:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source], abs=1e-6)
        times = Counter()
        for x in r.pieces:
            assert 0 <= x.first and x.words > 0 and x.first + x.words <= r.size and x["pass"] < passes
            times.update(range(x.first, x.first + x.words))
            taken[r.source] += x.words
            places[x.shard].add(x.place)
            draws[r.source].add((x.draw, x.shard, x.place))
            spans[x.shard, x.place, r.source] += x.words
        assert max(times.values(), default=0) <= passes
    for s in names:
        assert taken[s] == min(round(wanted[s]), 2 * sizes[s])
        assert len({d for d, _, _ in draws[s]}) == len(draws[s]) == len({d[1:] for d in draws[s]})
    for shard, found in places.items():
        assert found == set(range(len(found)))
    assert len({k[:2] for k in spans}) == len(spans)  # one source a place
    return taken, places, spans


def rows_of(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = op.mix(docs, block=16, shard=3_000).collect()
    _, places, spans = check(rows_of(docs), first)
    assert len(places) > 5 and max(spans.values()) <= 16
    again = op.mix(docs.repartition(7), block=16, shard=3_000, rows=3).collect()
    key = lambda r: str((r.doc_id, r.source, r.size))
    assert {key(r): r.size for r in again} == {key(r): r.size for r in first}
    other = op.mix(docs.repartition(5, "lang"), block=16, shard=3_000).collect()
    assert sorted(map(str, other)) == sorted(map(str, first))


def test_query_reruns_agree(spark):
    folder = "/root/testdata/sf0.001"
    first, again = (sorted(map(tuple, op.query(spark, folder).collect())) for _ in range(2))
    assert first == again and all(t <= 2 * s for _, s, _, _, t in first)
    by = defaultdict(lambda: [0, 0.0])
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for d, _, _, target, taken in first:
        by[source[d]][0] += taken
        by[source[d]][1] = target
    assert all(abs(t - w) <= 0.5 for t, w in by.values())


def test_hot_rows_nulls_and_ties(spark):
    rows = [(7, "one two three", "a")] * 50 + [(None, "x " * 9, None)] * 3 + [(1, None, "b"), (2, "", "b"), (3, " \t", "c"), (4, "w " * 5_000, "a"), (7, "other three words", "a"), (8, "ü ö", "z\U0001f600"), (9, "q", "z￿")]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = op.mix(df, block=4, shard=500, rows=2, copies=7).collect()
    check(rows, mixed)
    assert op.mix(df.where("false")).collect() == []
    empty = op.mix(df.where("doc_id < 4 AND doc_id > 0")).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.pieces) for r in empty) == [(1, 0, 0, 0.0, []), (2, 0, 0, 0.0, []), (3, 0, 0, 0.0, [])]


def test_extra_columns_do_not_clash(spark):
    df = spark.createDataFrame([(i, "a b c " * i, "s", i, i, i) for i in range(20)], SCHEMA + ", size int, th int, offset int")
    check(rows_of(df), op.mix(df).collect())


def test_shards_hold_the_words(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(1 + 7 * i % 40)), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = op.mix(df, block=8, shard=200).cache()
    written = op.shards(df, mixed)
    found = written.withColumn("task", F.spark_partition_id()).collect()
    assert all(0 < len(r.text.split()) <= 8 for r in found)
    for shard, held in Counter(r.shard for r in found).items():
        own = [r for r in found if r.shard == shard]
        assert [r.place for r in own] == list(range(held)) and len({r.task for r in own}) == 1
    taken = {r.doc_id: sum(x.words for x in r.pieces) for r in mixed.collect()}
    words = Counter(int(w[1:].split("w")[0]) for r in found for w in r.text.split())
    assert all(words[d] == n for d, n in taken.items())
    assert all(v <= 2 for v in Counter(w for r in found for w in r.text.split()).values())


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(op, "SOURCES", 3)
    df = spark.createDataFrame([(i, "a", f"s{i}") for i in range(4)], SCHEMA)
    with pytest.raises(ValueError, match="sources"):
        op.mix(df)
