"""Runs of words against a brute-force search over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelmill.llm import op12_periodic_runs as op


def brute(words, least=12):
    """All (start, length, period): maximal for the period, long enough, and no smaller period."""
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            t = s + p
            while t < n and words[t] == words[t - p]:
                t += 1
            if t - s >= max(least, 2 * p) and (s == 0 or words[s - 1] != words[s - 1 + p]):
                stretch = words[s:t]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                    found.append((s, t - s, p))
            s = max(s + 1, t - p + 1) if t > s + p else s + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(ident, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n, h = len(words), zlib.crc32(str(ident).encode())
    if ident is not None and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(ident, text):
    words = planted(ident, text)
    found = brute(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (ident, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def sequences():
    rng = random.Random(4)
    for letters in (1, 2, 3):
        for n in (11, 12, 13, 40, 90):
            yield [rng.randrange(letters) for _ in range(n)]
    fib = [0], [0, 1]
    while len(fib[1]) < 230:
        fib = fib[1], fib[1] + fib[0]
    yield fib[1]
    thue = [bin(i).count("1") & 1 for i in range(128)]
    yield thue
    for _ in range(60):
        words = []
        while len(words) < rng.randint(20, 160):
            unit = [rng.randrange(6) for _ in range(rng.randint(1, 15))]
            words += unit * rng.randint(1, 5) + unit[: rng.randint(0, len(unit))]
        yield words


def test_runs_against_brute_force():
    total = 0
    for sequence in sequences():
        words = [b"w%d" % i for i in sequence]
        assert op.runs(words) == brute(words)
        total += len(op.runs(words))
        numbers = np.array(sequence)
        assert op.stretch_runs(numbers, 2) == brute(sequence, 2)  # also short ones, without the windows
    assert total > 100


def test_access_colours_whole_paths():
    """After every access the segments met are those of a plain walk to the root."""
    rng = random.Random(9)
    for letters, n in ((1, 60), (2, 150), (5, 150)):
        words = [rng.randrange(letters) for _ in range(n)]
        link, _, prefixes = op.automaton(words)
        paths, colours = op.Paths(link), {}
        for end, state in enumerate(prefixes):
            walk, at, met = [], state, []
            while at:
                walk.append(at)
                at = link[at]
            for at in walk:
                if at in colours and (not met or met[-1][0] != colours[at]):
                    met.append((colours[at], at))
            assert paths.access(state, end) == met
            colours.update(dict.fromkeys(walk, end))


@pytest.mark.parametrize("table", ["sf0.001"])
def test_table_against_brute_force(spark, table):
    folder = f"/root/testdata/{table}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in op.query(spark, folder).collect()}
    assert len(got) >= len(docs) > 150
    for ident, text in docs:
        assert got[ident] == expected(ident, text)
    assert sum(r[1] for r in got.values()) > 10


def test_edge_cases(spark):
    period = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (4, "again " * 11), (5, "again " * 12), (None, f"x {period} {period} {period} y"), (6, "a b " * 20), (7, "z " * 30_000)]
    assert op.collapse(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, runs string")
    got = op.collapse(df).collect()
    plain = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(plain, key=str) == sorted(
        [
            (1, [], ""),
            (2, [], ""),
            (3, [], ""),
            (3, [], ""),
            (4, [], " ".join(["again"] * 11)),
            (5, [(0, 12, 1)], "again"),
            (None, [(1, 21, 7)], f"x {period} y"),
            (6, [(0, 20, 1)], "a b"),
            (7, [(0, 30_000, 1)], "z"),
        ],
        key=str,
    )
    told = {r.doc_id: tuple(r) for r in op.digests(op.collapse(df)).collect()}
    assert told[5][1:6] == (1, 0, 12, 1, 12_000) and told[1][1:6] == (0, None, None, None, None)
    assert told[1][6] == told[1][7] == hashlib.sha256(b"").hexdigest()
    schema = dict(op.digests(op.collapse(df)).dtypes)
    assert [schema[c] for c in ("n_runs", "start", "length", "period", "exponent_milli")] == ["bigint"] * 5
