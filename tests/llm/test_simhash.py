import random

import pytest
import xxhash
from pyspark.sql import functions as F

from panelmill.llm import op10_simhash as op

TABLE = "/root/testdata/sf0.001/documents.parquet"


def brute(rows):
    def mark(text):
        words = ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marks = [mark(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(marks):
        for j in range(i):
            if (x ^ marks[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        names[find(i)] = d if names.get(find(i)) is None else names[find(i)] if d is None else min(d, names[find(i)])
    return sorted(((d, f"{m:016x}", names[find(i)]) for i, ((d, _), m) in enumerate(zip(rows, marks, strict=True))), key=str)


def result(df):
    return sorted(map(tuple, op.near_duplicates(df).collect()), key=str)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(TABLE)
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edge_rows(spark):
    long = "one Two threeÄ " * 40_000
    rows = [(5, None), (2, ""), (9, " \t"), (None, "a b"), (4, "A B"), (4, "A B"), (7, long), (3, long + "x"), (8, "a b c d")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("bucket", [4, 4096])
def test_links_of_a_dense_family(spark, bucket):
    """Every link is found through the buckets, also when they are dealt again by bytes."""
    rng, base = random.Random(1), [0x0123456789ABCDEF, 0, (1 << 64) - 1]
    marks = {b for b in base} | {rng.getrandbits(64) for _ in range(50)}
    for _ in range(400):
        x = rng.choice(sorted(marks))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        marks.add(x)
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    found = op.components(op.links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket)).collect()
    root = {s: s for s in signed}
    root |= {r.node: r.root for r in found}
    want = {s: s for s in signed}
    for _ in range(len(signed)):
        changed = False
        for a, s in zip(marks, signed, strict=True):
            for b, t in zip(marks, signed, strict=True):
                if (a ^ b).bit_count() <= 3 and want[t] < want[s]:
                    want[s], changed = want[t], True
        if not changed:
            break
    assert root == want


def test_keep_first(spark):
    text = "a text of some words that is long enough to have shingles"
    rows = [(3, text, "en"), (1, text, "en"), (1, text, "en"), (None, text, "en"), (6, "quite another one", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FP string")
    kept = sorted((r.doc_id or -1 for r in op.keep_first(df).collect()))
    assert kept == [-1, 1, 6]


def test_keep_first_decides_each_text_of_an_id(spark):
    text = "a text of some words that is long enough to have shingles " * 30
    near, alone = text + "and", "quite another one that nobody else has written down so far"
    assert (op.fingerprint(text.encode()) ^ op.fingerprint(near.encode())).bit_count() <= 3
    rows = [(3, text), (7, alone), (7, near), (8, "two near texts " * 40), (8, "two near texts " * 41), (None, near), (None, text)]
    kept = op.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "7", "8", "None"]
    assert {r.text for r in kept if r.doc_id in (3, 7)} == {text, alone}


def test_variants_of_half_words_are_never_broadcast(spark):
    """66 variants a fingerprint, which Spark's sizes do not show: as many as fit the limit by its estimate fill the driver."""
    plan = op.links(spark.range(1000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan, plan
