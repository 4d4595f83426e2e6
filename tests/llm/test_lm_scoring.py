import math
import zlib
from collections import Counter

import numpy as np
import pytest

from panelmill.llm import op4_lm_scoring as op


def reached(count):
    """The largest of 1, 2, 3, 4, 6, 8, 12, ... that a count reaches, and the one after it."""
    steps = sorted({1} | {x * 2**k for k in range(1, 50) for x in (1, 1.5)})
    return max([0] + [x for x in steps if x <= count]), min(x for x in steps if x > count)


def brute(rows):
    split = lambda t: (t or "").encode().lower().split() + [b" "]
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not out(d) for w in split(t))
    pairs = Counter(p for d, t in rows if not out(d) for p in zip([b" ", *split(t)], split(t), strict=False))
    n, v = sum(counts.values()), len(counts)
    known = {w: reached(c) for w, c in counts.items()}
    linked = {p: reached(c)[0] for p, c in pairs.items()}

    def plain(h, w):
        alone = (known.get(w, (0,))[0] + 1) / (n + v + 1)
        return op.MIX * linked.get((h, w), 0) / (known[h][1] - 1) + (1 - op.MIX) * alone if h in known else alone

    result = []
    for d, t in rows:
        words = split(t)
        base = math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        score = math.fsum(math.log10(plain(h, w)) for h, w in zip([b" ", *words], words, strict=False))
        result.append((d, out(d), len(words), sum(counts[w] > 0 for w in words), n, base, score))
    return sorted(result, key=str)


def compare(df, rows, words=op.WORDS, **sizes):
    """Counts and base exactly; the caller judges the score, which the filter's false positives touch."""
    model, counted = op.train(df.where(~op.held_out(op.F.col("doc_id"))).select(op.F.coalesce("text", op.F.lit("")).alias("text")), words, **sizes)
    got = sorted((tuple(r) for r in op.score(df, model, counted, limit=1 << 16 if sizes else op.PASS).collect()), key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want, strict=True))
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got if g[4])
    return got


@pytest.mark.parametrize("words,sizes", [(op.WORDS, {}), (50, {"slice_tokens": 5000})])
def test_table_against_plain_model(spark, words, sizes):
    """In one pass, and in many passes over small slices."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = compare(df, rows, words, **sizes)
    gap = [abs(g[6] - w[6]) / w[2] for g, w in zip(got, brute(rows), strict=True)]
    assert max(gap) < 0.15 and sum(gap) / len(gap) < 0.01, (max(gap), sum(gap) / len(gap))  # log10 a token


def test_probabilities_sum_to_one_at_most(spark):
    """After every context of the table, trained or not, over all words and one unseen word, by the stored levels."""
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:60]
    split = [t.encode().lower().split() + [b" "] for t in texts]
    counts, pairs = Counter(w for t in split for w in t), Counter(p for t in split for p in zip([b" ", *t], t, strict=False))
    level = lambda c: np.searchsorted(op.THRESHOLDS, c, side="right")
    vocabulary, floor = list(counts), sum(counts.values()) + len(counts) + 1
    word = np.append(level([counts[w] for w in vocabulary]), 0)
    place, after = {w: i for i, w in enumerate(vocabulary)}, {}
    for (h, w), c in pairs.items():
        after.setdefault(h, []).append((place[w], c))
    masses = []
    for h in [*vocabulary[:500], None]:
        pair = np.zeros(len(word), np.int64)
        for i, c in after.get(h, []):
            pair[i] = level(c)
        masses.append(op.probability(pair, np.full(len(word), level(counts[h]) if h else 0), word, floor).sum())
    assert 0.3 < min(masses) and max(masses) <= 1 + 1e-9


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "A b a Ä x\u0085y"), (4, "word " * 200_000), (5, " \x0b\x0c "), (12, "never seen"), (12, "never seen")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, SCORE int")
    compare(df, rows)
    assert compare(df.limit(0), []) == []
    only = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 2] or [(9, "x")]
    model, counted = op.train(df.limit(0).select("text"))
    for r in op.score(spark.createDataFrame(only, "doc_id long, text string"), model, counted).collect():
        assert r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(r.n_tokens * math.log10(1 / 1))


def test_filter_keeps_every_pair(spark):
    """The level of every key is at least its own, and unseen keys are rarely found, whatever the number of slices."""
    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.zipf(1.3, 2000) % 5000)) for _ in range(30)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    hashes, counts = op.Hashes(), Counter()
    for t in texts:
        words = hashes.of([*op.tokens(t.encode()), b" "])
        counts.update(op.pair_keys(np.concatenate((words[-1:], words[:-1])), words).tolist() + words.tolist())
    keys, want = np.array(list(counts), np.uint64), np.searchsorted(op.THRESHOLDS, list(counts.values()), side="right")
    for tokens, limit in ((op.SLICE, op.PASS), (2000, 1 << 14)):
        counted = spark.createDataFrame(list(Counter(w for t in texts for w in [*op.tokens(t.encode()), b" "]).items()), "word binary, c long")
        table, sizes = op.build_filter(df, counted, 60_030, tokens)
        model = op.Model({}, np.zeros(1, np.int64), 0, 0, table, sizes)
        parts = [part for part, _ in model.passes(limit)]
        assert (len(parts) > 3) == (tokens == 2000)
        got = sum(part.levels(keys).astype(int) for part in parts)
        assert (got >= want).all() and (got == want).mean() > 0.9
        strange = op._mixed(np.arange(20_000, dtype=np.uint64))
        assert sum((part.levels(strange) > 0).sum() for part in parts) < 1000
        assert sum(sizes) * 8 < 1.2 * op.BITS_EACH * want.sum() + 64 * len(sizes)


def test_pairs_help(spark):
    """Texts of the training kind are likelier under the mixed model than under words alone."""
    text = "the cat sat on the mat and the dog lay on the rug"
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    got = compare(df, [(i, text) for i in range(40)])
    assert all(g[6] > g[5] + 3 for g in got)


def test_end_is_numbered_whatever_its_rank(spark):
    """Every word here is more frequent than the end, and fewer words are numbered than that."""
    rows = [(i, "a b c a b a " * 50 + "rare") for i in (1, 3, 4)]
    assert sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows) >= 2
    got = compare(spark.createDataFrame(rows, "doc_id long, text string"), rows, words=1)
    assert all(g[3] == g[2] for g in got)


def test_numbered_words_bring_their_hashes():
    """Scoring keeps no table of the words it met: numbered ones have their hash by number, the others are hashed."""
    words = [b"b", b"zz", b"a", b" ", b"a"]
    model = op.Model({b"a": 0, b"b": 1, b" ": 2}, np.array([5, 4, 3, 9]), 21, 9, None, [])
    asked = []

    class Part:
        def levels(self, keys):
            asked.append(keys)
            return np.zeros(len(keys), np.uint8)

    levels, numbers = op._look(Part(), model, words, np.array([4, 1]), None)
    plain = np.array([op.xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    end = plain[3]
    assert numbers.tolist() == [1, 3, 0, 2, 0]
    assert (asked[0] == op.pair_keys(np.array([end, plain[0], plain[1], plain[2], end]), plain)).all() and (asked[1] == plain[1:2]).all()
