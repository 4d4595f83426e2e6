import hashlib
import random

import pytest

from panelmill.llm import op7_suffix_dedup as op


def brute(rows):
    docs = sorted({(d is None, d or 0, (t or "").encode()) for d, t in rows})
    # rows equal in id and text are one document; ties of one id are broken by a hash, so the tests use distinct ids otherwise
    seen, out = set(), {}
    for none, d, data in docs:
        hit = bytearray(len(data))
        for i in range(len(data) - op.LENGTH + 1):
            w = data[i : i + op.LENGTH]
            if w in seen:
                hit[i : i + op.LENGTH] = b"\x01" * op.LENGTH
            seen.add(w)
        spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(hit)))
        kept = bytes(c for c, h in zip(data, hit, strict=True) if not h)
        out[none, d, data] = (len(data), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((d, *out[d is None, d or 0, (t or "").encode()]) for d, t in rows), key=str)


def result(df, crowd):
    cut = op.remove_repeats(df, crowd=crowd)
    return sorted(map(tuple, cut.select("doc_id", "n_bytes", "n_removed", "n_spans", op.F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("crowd", [4096, 2])
def test_table_against_brute_force(spark, crowd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    assert result(docs, crowd) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("crowd", [4096, 3])
def test_planted_repeats(spark, crowd):
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh éx ") for _ in range(n))
    lines = [make(rng.choice([60, 99, 100, 101, 130, 400])) for _ in range(12)]
    rows = [(i, "".join(rng.choice([make(rng.randint(0, 90)), rng.choice(lines)]) for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(20)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), crowd) == brute(rows)


def test_edge_rows(spark, monkeypatch):
    line = "0123456789" * 10
    rows = [
        (1, None), (2, ""), (3, "a" * 5000), (4, "a" * 99), (5, "a" * 100), (None, line + "!"), (6, line), (6, line), (7, "ab" * 400), (8, line[:99]),
        (9, line * 3 + "z" + line),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, RUNS int")
    assert result(df, 4096) == brute(rows) == result(df, 1)
    assert result(df.limit(0), 4096) == []


def test_segments_name_the_same_grams(monkeypatch):
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    whole = op.stretches(text)
    monkeypatch.setattr(op, "SEGMENT", 500)
    parts = op.stretches(text)
    of = lambda s: [g for g, n in zip(s[0].tolist(), s[3].tolist(), strict=True) for _ in range(n)]
    assert of(whole) == of(parts) and len(of(whole)) == len(text) - op.LENGTH + 1
